"""Text expressions: tokens, cleaning, globs, entropy, paths.  All are native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms.
STOPWORDS = (
    "the and for with this that have from will would could should been were they their there what when "
    "where which about into your more also some like just than then these those such each make made "
    "need want look know take come here how not but can all are was has its let new use used using "
    "get got add set run now see way any one two file code line lines test type data class function"
).split()
# Fixed value: characters that a term has at least.
MIN_TERM = 4
# Patterns of secrets (I9) as (name, pattern, least length).  \b is written out, as Java's is not ASCII.
SECRET_PATTERNS = [
    ("aws_access_key", r"AKIA[0-9A-Z]{16}", 0),
    ("github_token", r"(?<![A-Za-z0-9_])(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", 0),
    ("jwt", r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*[A-Za-z0-9_](?![A-Za-z0-9_])", 40),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", 0),
]
# Words and tokens of the entropy rule, least entropy, lines looked at on either side, largest text.
SECRET_WORDS = r"(?i)SECRET|KEY|PASSWORD|TOKEN|CREDENTIAL|PRIVATE_KEY|API_KEY"
SECRET_TOKEN = r"[A-Za-z0-9+/=_-]{40,}"
MIN_ENTROPY = 4.5
CONTEXT_LINES = 5
MAX_REDACT = 5 * 1024 * 1024


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, of MIN_TERM characters or more, without stopwords."""
    plain = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))
    return F.filter(F.split(plain, "[^a-z0-9_]+"), lambda t: (F.length(t) >= MIN_TERM) & ~t.isin(STOPWORDS))


def without_reminders(text: Column) -> Column:
    """Without system-reminder blocks."""
    return F.regexp_replace(text, r"(?s)<system-reminder>.*?</system-reminder>", "")


def label_words(text: Column) -> Column:
    """Distinct alphanumeric words of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """H8: of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def body_hash(text: Column) -> Column:
    """I4: SHA-256, null for an empty text."""
    return F.when(F.length(text) > 0, F.sha2(text.cast("binary"), 256))


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored pattern: * is anything, also /, ? one character, all else itself."""
    escaped = F.regexp_replace(glob, r"([\\.+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(F.regexp_replace(escaped, r"\*", ".*"), r"\?", "."), F.lit("$"))


def glob_matches(path: Column, glob: Column) -> Column:
    return F.call_function("rlike", path, glob_pattern(glob))


def basename(path: Column) -> Column:
    """I7."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """I7: "." for a path without a folder."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extname(path: Column) -> Column:
    """From the last dot of the name on, unless the name begins with it."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1)


def normalized(path: Column) -> Column:
    """Without . and .. segments."""
    step = lambda acc, s: (
        F.when((s == ".") | (s == ""), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def import_candidates(source_file: Column, target: Column) -> Column:
    """Files that a relative import may mean, in order."""
    base = normalized(F.concat(dirname(source_file), F.lit("/"), target))
    endings = ["", ".js", "/index.js", ".ts", ".tsx", "/index.ts", ".py", "/__init__.py", ".svelte"]
    return F.array(*[F.concat(base, F.lit(e)) for e in endings])


def line_of(text: Column, position: Column) -> Column:
    """Line, from 1, of the character at position (from 0)."""
    before = F.substring(text, F.lit(1), position)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def parsed_time(text: Column) -> Column:
    """Of ISO or plain text."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def clamp_confidence(value: Column) -> Column:
    """To [0, 1]; NaN and null are refused."""
    bad = value.isNull() | F.isnan(value)
    return F.when(bad, F.raise_error(F.lit("confidence must be a number"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def slug(text: Column) -> Column:
    """I18."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def format_bytes(n: Column) -> Column:
    """I18."""
    kb, mb = n / 1024.0, n / 1048576.0
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(mb < 1, F.concat(F.format_number(kb, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(mb, 1), F.lit(" MB")))


def line_range(text: Column) -> tuple[Column, Column]:
    """First and last line of L10-L20 or L10; nulls for anything else."""
    first = F.try_to_number(F.nullif(F.regexp_extract(text, r"^L?(\d+)(?:-L?\d+)?$", 1), F.lit("")), F.lit("999999999")).cast("int")
    last = F.try_to_number(F.nullif(F.regexp_extract(text, r"^L?\d+-L?(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int")
    return first, F.coalesce(last, first)


def short_stat(text: Column) -> list[Column]:
    """Files, insertions, deletions of a git shortstat line."""
    number = lambda p: F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int"), F.lit(0))
    return [number(r"(\d+) files? changed"), number(r"(\d+) insertions?"), number(r"(\d+) deletions?")]


def date_prefix(text: Column) -> Column:
    """The first ten characters."""
    return F.substring(text, 1, 10)


def month_day(at: Column) -> Column:
    """As in "Mar 7"."""
    return F.date_format(at, "MMM d")


def clock(text: Column) -> Column:
    """The first HH:MM of a text, or an empty one."""
    return F.regexp_extract(text, r"(\d{2}:\d{2})", 1)


def short_sha(sha: Column) -> Column:
    """I20."""
    return F.substring(F.coalesce(sha, F.lit("")), 1, 7)


def folder_name(cwd: Column) -> Column:
    """A working folder as the name of its log folder."""
    return F.translate(cwd, "/", "-")


_METACHARACTERS = re.compile(r"([.^$*+?()\[\]{}|\\])")


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """A gitignore line as (pattern on a relative path, negated); None for blanks and comments."""
    line = line.strip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    body = line[1:] if negated else line
    folder, body = body.endswith("/"), body.strip("/") if not body.startswith("/") else body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out = ""
    k = 0
    while k < len(body):
        if body.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif body.startswith("**", k):
            out, k = out + ".*", k + 2
        elif body[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif body[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + _METACHARACTERS.sub(r"\\\1", body[k]), k + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.*)?'}$", negated


# Folders and secret files that are never read.
BUILTIN_IGNORES = (
    "node_modules/ .git/ .next/ dist/ build/ .cache/ coverage/ .nyc_output/ __pycache__/ .venv/ vendor/ "
    "*.env *.key *.pem *.p12 *.pfx id_rsa* *.crt *.csr"
).split()


def excluded(path: Column, rules: list[str]) -> Column:
    """C14: the last rule that matches decides; paths that leave the tree are excluded."""
    out = F.lit(False)
    for compiled in filter(None, map(ignore_pattern, rules)):
        out = F.when(path.rlike(compiled[0]), F.lit(not compiled[1])).otherwise(out)
    return path.startswith("../") | path.startswith("/") | out
