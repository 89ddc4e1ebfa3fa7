"""Queries over texts: terms, search, lines, secrets, markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import redact as r
from ..operators import search as s
from ..sources import adapters as a
from .base import query

STOP = ", ".join(f"'{w}'" for w in x.STOPWORDS)
TOKENS = f"list_filter(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[^a-z0-9_]+'), lambda t: length(t) >= 4 AND NOT list_contains([{STOP}], t))"
LINES = r"""lines AS (SELECT source AS project, lang || '/' || doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no
  FROM documents WHERE NOT contains(text, chr(0)))"""


def _docs(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("ln"), "text")


@query("tokenize_terms", "I1", f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark, sf_dir):
    each = a.table(spark, sf_dir, "documents").select(F.explode(x.tokens(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n"))


def _top(keys: str, ln: str, table: str, where: str = "true") -> str:
    return f"""WITH t AS (SELECT {keys}, {ln} AS ln, {TOKENS} AS ts FROM {table} WHERE {where}), e AS (SELECT * EXCLUDE ts, unnest(ts) AS term, generate_subscripts(ts, 1) AS k FROM t),
c AS (SELECT * EXCLUDE (ln, k), count(*) AS n, min(ln * 1000000 + k) AS p FROM e GROUP BY ALL)
SELECT * EXCLUDE p FROM (SELECT *, row_number() OVER (PARTITION BY {", ".join(k.split(" AS ")[-1] for k in keys.split(", "))} ORDER BY n DESC, p, term)::INT AS rank FROM c) WHERE rank <= 8"""


@query("top_terms_per_source", "E8 F6", _top("source", "doc_id", "documents"))
def top_terms_per_source(spark, sf_dir):
    return s.top_terms(_docs(spark, sf_dir), ["source"])


@query("postings", "K1", _top("conv_id::VARCHAR AS session_id, role AS side", "turn", "conversations", "role IN ('user', 'assistant')"))
def postings(spark, sf_dir):
    return s.top_terms(a.messages(spark, sf_dir).where("side IN ('user', 'assistant')"), ["session_id", "side"])


@query("rebuild_index", "K2", f"SELECT DISTINCT conv_id::VARCHAR AS session_id, role AS side, unnest({TOKENS}) AS term FROM conversations WHERE role IN ('user', 'assistant')")
def rebuild_index(spark, sf_dir):
    return s.full_index(a.messages(spark, sf_dir).where("side IN ('user', 'assistant')"), ["session_id", "side"])


INDEX = f"idx AS (SELECT DISTINCT conv_id::VARCHAR AS window_id, unnest({TOKENS}) AS term FROM conversations WHERE role IN ('user', 'assistant'))"


def _index(spark, sf_dir):
    return s.full_index(a.messages(spark, sf_dir).where("side IN ('user', 'assistant')").withColumnRenamed("session_id", "window_id"), ["window_id"])


@query(
    "search_cnf",
    "K3 H1 H2 G5",
    f"""WITH {INDEX} SELECT window_id, 2::BIGINT AS score FROM idx GROUP BY ALL HAVING count(*) FILTER (term IN ('tion', 'ther')) > 0 AND count(*) FILTER (term IN ('than', 'ering', 'ingth')) > 0""",
)
def search_cnf(spark, sf_dir):
    return s.search(_index(spark, sf_dir), [["tion", "ther"], ["than", "Ering", "ingth"]])


@query("search_promoted_stopwords", "I26", f"WITH {INDEX} SELECT window_id, 1::BIGINT AS score FROM idx WHERE term IN ('than', 'ingth') GROUP BY ALL")
def search_promoted_stopwords(spark, sf_dir):
    promoted = spark.createDataFrame([("tion",), ("ther",)], "term string")
    return s.search(_index(spark, sf_dir), [["tion", "ther"], ["than", "ingth"]], promoted)


@query(
    "grep_context",
    "K5 F8 G7",
    rf"""WITH {LINES}, w AS (SELECT project, file, line_no, text, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY project, file ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, chr(10)) OVER (PARTITION BY project, file ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), '') AS after FROM lines)
SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY project, file ORDER BY line_no) AS n FROM w WHERE regexp_matches(text, 'token|[Ii]ng the ')) WHERE n <= 20""",
)
def grep_context(spark, sf_dir):
    return s.grep(s.lines(a.files(spark, sf_dir)), "token|[Ii]ng the ").select("project", "file", "line_no", "text", "before", "after")


@query(
    "classify_variants",
    "K6 F9 E11",
    rf"""WITH {LINES}, f AS (SELECT *, regexp_matches(text, '^\s*#|assert|expect\s*\(|it\s*\(') AS ref, regexp_matches(text, 'https?://') AS cfg,
  [CASE WHEN contains(text, '###') THEN 'hash' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shout' END] AS vs FROM lines),
h AS (SELECT project, file, unnest(list_filter(vs, lambda v: v IS NOT NULL)) AS variant, CASE WHEN ref THEN 'reference' WHEN cfg THEN 'config' ELSE 'unknown' END AS direction FROM f),
n AS (SELECT variant, direction, count(*) AS hits, count(DISTINCT project || '/' || file) AS files FROM h GROUP BY ALL)
SELECT *, floor(hits * 100.0 / sum(hits) OVER () + 0.5)::BIGINT AS share FROM n""",
)
def classify_variants(spark, sf_dir):
    hits = s.classify(s.lines(a.files(spark, sf_dir)), {"hash": "###", "table": r"\|", "shout": "!!"})
    return s.classify_totals(hits)


@query("body_hash", "I4", "SELECT doc_id, CASE WHEN length(text) > 0 THEN sha256(text) END AS hash FROM documents")
def body_hash(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", x.body_hash(F.col("text")).alias("hash"))


@query("redact_counts", "I9 I10 F14 R5")
def redact_counts(spark, sf_dir):
    return r.redact_files(a.files(spark, sf_dir)).select("project", "file", "n", "kinds", F.length("redacted").alias("length"))


@query(
    "entropy_tokens",
    "E15 F10 I9",
    rf"""WITH {LINES}, near AS (SELECT *, bool_or(regexp_matches(text, '(?i)SECRET|KEY|PASSWORD|TOKEN|CREDENTIAL')) OVER (PARTITION BY project, file ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lines),
t AS (SELECT project, file, line_no, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{{40,}}')) AS token FROM near WHERE near),
b AS (SELECT *, list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -(length(token) - length(replace(token, c, '')))::DOUBLE / length(token)
   * log2((length(token) - length(replace(token, c, '')))::DOUBLE / length(token)))) AS bits FROM t)
SELECT project, file, line_no, token, round(bits, 6) AS bits FROM b WHERE bits >= 4.5""",
)
def entropy_tokens(spark, sf_dir):
    return s.entropy_tokens(s.lines(a.files(spark, sf_dir))).withColumn("bits", F.round("bits", 6))


@query(
    "html_links",
    "H6",
    r"""SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
)
def html_links(spark, sf_dir):
    return a.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("href")).distinct()


@query(
    "html_sections",
    "B9",
    r"""SELECT page_id, length(regexp_extract(html, '(?s)<script[^>]*>.*?</script>')) AS script_chars, length(regexp_extract(html, '(?s)<style[^>]*>.*?</style>')) AS style_chars,
  length(trim(regexp_replace(html, '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g'))) AS template_chars FROM pages""",
)
def html_sections(spark, sf_dir):
    part = lambda t: F.length(F.regexp_extract("html", rf"(?s)<{t}[^>]*>.*?</{t}>", 0)).cast("long").alias(f"{t}_chars")
    rest = F.trim(F.regexp_replace("html", r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""))
    return a.table(spark, sf_dir, "pages").select("page_id", part("script"), part("style"), F.length(rest).cast("long").alias("template_chars"))


ALIASES = "aliases AS (SELECT n_name AS alias, r_name AS project, 'nation/' || n_nationkey AS file FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    "alias_resolve",
    "K7",
    f"""WITH {ALIASES}, asked AS (SELECT * FROM (VALUES ('NATION_3', 'EUROPE'), ('nation_3', NULL), ('asia nation_2', NULL), ('tion_1', NULL), ('zzz', NULL)) t(query, hint)),
h AS (SELECT query, hint, alias, project, file, CASE WHEN lower(alias) = lower(query) AND project = hint THEN 0 WHEN lower(alias) = lower(query) THEN 1
  WHEN lower(query) = lower(project) || ' ' || lower(alias) THEN 2 WHEN contains(lower(alias), lower(query)) THEN 3 END AS tier FROM aliases, asked)
SELECT query, hint, tier, alias, project, file FROM (SELECT *, min(tier) OVER (PARTITION BY query, hint) AS best FROM h WHERE tier IS NOT NULL) WHERE tier = best""",
)
def alias_resolve(spark, sf_dir):
    aliases = a.graph_nodes(spark, sf_dir).where("type = 'nation'").select(F.col("name").alias("alias"), "project", "file")
    asked = [("NATION_3", "EUROPE"), ("nation_3", None), ("asia nation_2", None), ("tion_1", None), ("zzz", None)]
    return s.resolve_alias(aliases, spark.createDataFrame(asked, "query string, hint string"))


@query(
    "alias_seed",
    "K8",
    """WITH n AS (SELECT r_name AS project, 'nation/' || n_nationkey AS file, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT project AS alias, project, NULL::VARCHAR AS file, 'seed' AS source FROM n
UNION ALL SELECT lower(project || ' ' || name), project, file, 'seed' FROM n""",
)
def alias_seed(spark, sf_dir):
    nodes = a.graph_nodes(spark, sf_dir).where("type = 'nation'").withColumn("type", F.lit("function"))
    return s.seed_aliases(nodes)
