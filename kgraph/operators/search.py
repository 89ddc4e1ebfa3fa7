"""Terms, postings, search, line context, classification, aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x


def term_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, term, n, first_pos; rows: keys, ln, text.  first_pos orders terms as they are first seen."""
    each = rows.select(*keys, "ln", F.posexplode(x.tokens(x.without_reminders(F.col("text")))).alias("k", "term"))
    first = F.min(F.struct("ln", "k"))
    return each.groupBy(*keys, "term").agg(F.count("*").alias("n"), first.alias("first_pos"))


def top_terms(rows: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """The k commonest terms of each key, ties to the one seen first, then by term."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), "first_pos", "term")
    ranked = term_counts(rows, keys).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(*keys, "term", "n", "rank")


def full_index(rows: DataFrame, keys: list[str]) -> DataFrame:
    """K2: all distinct tokens of each key."""
    return rows.select(*keys, F.explode(F.array_distinct(x.tokens(F.col("text")))).alias("term")).distinct()


def search(postings: DataFrame, clusters: list[list[str]], promoted: DataFrame | None = None, key: str = "window_id") -> DataFrame:
    """Keys that hold, of every cluster, one of its terms.  Promoted stopwords leave their cluster, and
    a cluster that is empty then is ignored; score is the number of clusters."""
    wanted = [(k, t.strip().strip("\"'").lower()) for k, c in enumerate(clusters) for t in c if t.strip()]
    spark = postings.sparkSession
    asked = spark.createDataFrame(wanted, "cluster int, term string").distinct()
    if promoted is not None:
        asked = asked.join(promoted.select("term"), "term", "left_anti")
    n = asked.agg(F.countDistinct("cluster").alias("score"))
    hits = postings.join(F.broadcast(asked), "term").groupBy(key).agg(F.countDistinct("cluster").alias("found"))
    return hits.join(F.broadcast(n), F.col("found") == F.col("score")).select(key, "score")


def lines(files: DataFrame) -> DataFrame:
    """project, file, line_no (from 1), text; files with a NUL character are binary and left out."""
    kept = files.where(~F.contains("content", F.lit("\x00")))
    return kept.select("project", "file", F.posexplode(F.split("content", "\n", -1)).alias("k", "text")).select("project", "file", (F.col("k") + 1).alias("line_no"), "text")


def grep(rows: DataFrame, pattern: str, context: int = 3, per_file: int = 20) -> DataFrame:
    """Matching lines with those before and after, at most per_file of a file.

    Hits are found first; only lines near one are gathered, by equality of their number."""
    order = Window.partitionBy("project", "file").orderBy("line_no")
    hits = rows.where(F.col("text").rlike(pattern)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_file).drop("n")
    steps = F.explode(F.array(*[F.lit(k) for k in (*range(-context, 0), *range(1, context + 1))])).alias("step")
    near = hits.select("project", "file", F.col("line_no").alias("hit_no"), steps).withColumn("line_no", F.col("hit_no") + F.col("step"))
    found = near.join(rows.select("project", "file", "line_no", F.col("text").alias("other")), ["project", "file", "line_no"])
    side = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("step", "other")))), lambda r: r["other"]), "\n")
    around = found.groupBy("project", "file", F.col("hit_no").alias("line_no")).agg(side(F.col("step") < 0).alias("before"), side(F.col("step") > 0).alias("after"))
    return hits.join(around, ["project", "file", "line_no"], "left").fillna("", ["before", "after"])


# What tells the direction of a line.  \b is ASCII here.
_W = "(?<![A-Za-z0-9_])"
DIRECTIONS = {
    "client": [
        _W + r"fetch\s*\(", r"\.get\s*\(", r"\.post\s*\(", r"\.put\s*\(", r"\.patch\s*\(", r"\.delete\s*\(", "XMLHttpRequest",
        r"\$\.ajax", r"\$\.get", r"\$\.post", _W + r"import\s*\(", r"window\.location", r"location\.href", r"\.href\s*=", r"\.src\s*=",
    ],
    "server": [
        _W + r"app\.(get|post|put|patch|delete|use)\s*\(", _W + r"router\.(get|post|put|patch|delete|use)\s*\(", _W + r"res\.redirect",
        _W + r"res\.json", _W + r"res\.send", _W + r"res\.status", r"\.prepare\s*\(", r"\.exec\s*\(",
    ],
    "config": [
        r"apiBase\s*[:=]", r"baseUrl\s*[:=]", r"baseURL\s*[:=]", r"endpoint\s*[:=]", r"href\s*=\s*[\"']", r"src\s*=\s*[\"']",
        r"action\s*=\s*[\"']", r"const\s+\w*[Uu][Rr][Ll]\s*=", r"var\s+\w*[Uu][Rr][Ll]\s*=", r"let\s+\w*[Uu][Rr][Ll]\s*=",
        r"var\s+API\s*=", r"const\s+API\s*=", r"let\s+API\s*=", r"https?://", r"ics:\s*['\"]", r"url:\s*['\"]", r"apiBase\s*:",
    ],
    "reference": [
        r"^\s*//", r"^\s*/?\*", r"^\s*#", r"^\s*<!--", r"\.test\s*\(", r"\.get\s*\(\s*['\"]/", "supertest", "assert", r"expect\s*\(",
        r"describe\s*\(", r"it\s*\(", r"console\.log\s*\(.*`", r"process\.exit",
    ],
}


def classify(rows: DataFrame, variants: dict[str, str], around: int = 2) -> DataFrame:
    """A row per line and variant that it matches, with a direction.  Rules in order: reference (line), client
    (line), client (near), server (line), server (near), config (line), unknown."""
    is_ = {d: F.col("text").rlike("|".join(f"(?:{p})" for p in ps)) for d, ps in DIRECTIONS.items()}
    near = Window.partitionBy("project", "file").orderBy("line_no").rowsBetween(-around, around)
    flags = rows.withColumns({f"is_{d}": c for d, c in is_.items()})
    flags = flags.withColumns({f"near_{d}": F.max(f"is_{d}").over(near) for d in ("client", "server")})
    direction = (
        F.when(F.col("is_reference"), "reference").when(F.col("near_client"), "client").when(F.col("is_server"), "server")
        .when(F.col("near_server"), "server").when(F.col("is_config"), "config").otherwise("unknown")
    )
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(v)) for v, p in variants.items()]))
    return flags.select("project", "file", "line_no", "text", direction.alias("direction"), F.explode(hits).alias("variant"))


def classify_totals(hits: DataFrame) -> DataFrame:
    """Hits, files and rounded share of each variant and direction."""
    n = hits.groupBy("variant", "direction").agg(F.count("*").alias("hits"), F.countDistinct("project", "file").alias("files"))
    return n.withColumn("share", F.floor(F.col("hits") * 100.0 / F.sum("hits").over(Window.partitionBy()) + 0.5).cast("long"))


def keyword_near(rows: DataFrame, pattern: str, around: int = x.CONTEXT_LINES) -> DataFrame:
    """with near: does a line within so many lines match?"""
    span = Window.partitionBy("project", "file").orderBy("line_no").rowsBetween(-around, around)
    return rows.withColumn("near", F.max(F.col("text").rlike(pattern)).over(span))


def entropy_tokens(rows: DataFrame) -> DataFrame:
    """Long tokens of high entropy near a secret word, with their line."""
    found = keyword_near(rows, x.SECRET_WORDS).where("near").select("project", "file", "line_no", F.explode(F.regexp_extract_all("text", F.lit(x.SECRET_TOKEN), 0)).alias("token"))
    return found.withColumn("bits", x.entropy(F.col("token"))).where(F.col("bits") >= x.MIN_ENTROPY)


def resolve_alias(aliases: DataFrame, wanted: DataFrame) -> DataFrame:
    """K7: wanted: query, hint (may be null).  The first tier with a match wins: exact in the hinted project, exact,
    "<project> rest" of that project, contained."""
    q, al = F.lower(F.col("query")), F.lower(F.col("alias"))
    rest = F.expr("substring(lower(query), length(project) + 2)")
    tier = (
        F.when((al == q) & (F.col("project") == F.col("hint")), 0)
        .when(al == q, 1)
        .when(q.startswith(F.concat(F.lower("project"), F.lit(" "))) & (al == rest), 2)
        .otherwise(3)
    )
    hits = aliases.join(F.broadcast(wanted), al.contains(q) | ((q.startswith(F.concat(F.lower("project"), F.lit(" ")))) & (al == rest)))
    found = hits.withColumn("tier", tier).withColumn("best", F.min("tier").over(Window.partitionBy("query", "hint")))
    return found.where("tier = best").select("query", "hint", "tier", "alias", "project", "file")


def seed_aliases(nodes: DataFrame) -> DataFrame:
    """K8: the project; a file's stem if it has three definitions or a route or middleware and is not an index;
    "<project> <function>" in lower case.  One row per alias and project."""
    project = nodes.select(F.col("project").alias("alias"), "project", F.lit(None).cast("string").alias("file"))
    defs = F.count(F.when(F.col("type").isin("function", "class", "method"), 1))
    special = F.max(F.col("type").isin("route", "middleware"))
    stem = F.regexp_replace(x.basename(F.col("file")), r"\.[^.]*$", "")
    files = nodes.groupBy("project", "file").agg(defs.alias("n"), special.alias("special")).withColumn("alias", stem)
    files = files.where(((F.col("n") >= 3) | F.col("special")) & (F.col("alias") != "index")).select("alias", "project", "file")
    calls = nodes.where("type = 'function'").select(F.lower(F.concat_ws(" ", "project", "name")).alias("alias"), "project", "file")
    every = reduce(DataFrame.unionByName, [project, files, calls])
    return every.groupBy("alias", "project").agg(F.min("file").alias("file")).withColumn("source", F.lit("seed"))
