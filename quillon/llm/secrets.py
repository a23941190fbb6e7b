"""Secret scans with corpus-wide ownership frequency, in DataFrame operations.

Patterns find candidate values; each value's hash is then counted over the whole corpus by
distinct repositories and distinct owners. A value that many owners hold is a copied example; a
value that stays with few owners looks live. Values of the named kinds (assign, access, hex) are
always reported; runs of mixed characters without a key word beside them are reported as
``owned`` only when they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, pick

#: Patterns of the named kinds. The minimum lengths are part of the patterns of access and hex:
#: their matches are whole runs, so a failing match never hides a longer one. An assign match may
#: (its value can hold a key word), so it is filtered after matching.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Runs that may be bare credentials: 20 or more characters.
BARE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: From so many owners, or so many repositories, on a value is a copied example.
WIDE, WIDE_REPOS = 3, 10
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _width(items: Column) -> Column:
    """About the cube root of the array's size."""
    return F.greatest(F.lit(1), F.ceil(F.cbrt(F.size(items))).cast("int"))


def _sliced(items: Column, width: Column) -> Column:
    """The array in slices of that width; one, empty, of an empty array. Both are worked out for
    each slice, so they should be columns or variables."""
    last = F.greatest(F.lit(1), F.ceil(F.size(items) / width).cast("int"))
    return F.transform(F.sequence(F.lit(1), last), lambda k: F.slice(items, (k - 1) * width + 1, width))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def found(text: Column, pattern: str, kind: int) -> Column:
    """Array of SPAN: the leftmost non-overlapping matches, in code points.

    What lies between the matches comes from splitting at them; running lengths give places.
    """
    none = F.expr(f"CAST(array() AS array<{SPAN}>)")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        gaps, hits, lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.length(hit).alias("size"), hit.alias("hit"))
    )
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    zero = F.lit(0).cast("long")

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + pair["size"]
        value = F.regexp_extract(pair["hit"], ASSIGN, 2) if kind == 0 else pair["hit"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def placed(parts: Column) -> Column:
        """Each slice's spans from where the slice starts."""
        start = F.struct(zero.alias("at"), F.expr("CAST(array() AS array<bigint>)").alias("starts"))
        taken = F.transform(parts, lambda part: F.aggregate(part, zero, lambda n, p: n + p["gap"] + p["size"]))
        starts = F.aggregate(
            taken,
            start,
            lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"],
        )
        return F.flatten(
            F.zip_with(
                parts,
                starts,
                lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("spans")), step, lambda acc: acc["spans"]),
            )
        )

    spans = _let(pairs, lambda p: _let(_sliced(p, _width(p)), placed))
    return F.when(F.size(hits) == 0, none).otherwise(spans)


def _boxes(items: Column, width: Column) -> Column:
    """Slices of spans, or of boxes, each with where its first starts and its last ends."""
    return F.transform(
        F.filter(_sliced(items, width), lambda p: F.size(p) > 0),
        lambda p: F.struct(
            F.array_min(F.transform(p, lambda o: o["start"])).alias("start"),
            F.array_max(F.transform(p, lambda o: o["end"])).alias("end"),
            p.alias("inside"),
        ),
    )


def apart(spans: Column, others: Column) -> Column:
    """The spans that look random and overlap none of the others."""
    def over(s: Column, o: Column) -> Column:
        return (o["start"] < s["end"]) & (s["start"] < o["end"])

    def met(s: Column, boxes: Column) -> Column:
        small = lambda box: over(s, box) & F.exists(box["inside"], lambda o: over(s, o))
        return F.exists(boxes, lambda box: over(s, box) & F.exists(box["inside"], small))

    random = F.filter(spans, lambda s: _looks_random(s["value"]))
    boxes = _let(_width(others), lambda width: _let(_boxes(others, width), lambda small: _boxes(small, width)))
    return F.when(F.size(spans) == 0, spans).otherwise(
        _let(boxes, lambda boxes: F.filter(random, lambda s: ~met(s, boxes)))
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(shown, ",")


def _looks_random(value: Column) -> Column:
    """Lower and upper case, digits, and at least 12 different characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (distinct >= 12)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    wide: int = WIDE,
    wide_repos: int = WIDE_REPOS,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    repos, owners.

    A value that wide owners or wide_repos repositories hold is copied, any other one live; both
    counts are exact. n_live and n_copied count the document's reported spans by
    that. repos and owners are the most distinct ones of any value of the document, runs that are
    not reported included, 0 without values. A null repository or owner counts as one of its own. Null and empty texts have no spans: counts 0, the digest of the empty string, an empty spans
    string. Rows that repeat an id are scanned each. An empty table gives no rows.
    """
    docs = pick(docs, id_col, text_col, repo_col, owner_col).toDF("doc_id", "text", "repo", "owner")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("r"), F.col("repo").cast("string")), F.lit("n")).alias("repo"),
        F.coalesce(F.concat(F.lit("o"), F.col("owner").cast("string")), F.lit("n")).alias("owner"),
        F.filter(found(text, ASSIGN, 0), lambda s: F.length(s["value"]) >= 12).alias("assign"),
        found(text, ACCESS, 1).alias("access"),
        found(text, HEX, 2).alias("hex"),
        found(text, BARE, 3).alias("bare"),
    )
    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    hashed = F.transform(
        F.concat("base", apart(F.col("bare"), F.col("base"))),
        lambda s: F.struct(s["start"], s["kind"], s["end"], F.sha2(s["value"], 256).alias("value")),
    )
    rows = cut(
        rows.select(
            "row", "doc_id", "repo", "owner",
            F.size("assign").cast("long").alias("n_assign"),
            F.size("access").cast("long").alias("n_access"),
            F.size("hex").cast("long").alias("n_hex"),
            F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
            hashed.alias("all"),
        ),
        "secrets-rows",
    )
    spans = rows.where(F.size("all") > 0).select("row", "owner", "repo", F.inline("all"))
    counted = _wide(spans, "owner", "owners").join(_wide(spans, "repo", "repos"), "value")
    live = (F.col("owners") < wide) & (F.col("repos") < wide_repos)
    held = spans.select("row", "start", "kind", "end", "value").join(counted, "value").withColumn("live", live)
    told = held.groupBy("row").agg(
        joined(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", "end", "value")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live") & (F.col("kind") < 3)).alias("n_copied"),
        F.max("repos").alias("repos"),
        F.max("owners").alias("owners"),
    )
    return rows.join(told, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce("spans", F.lit("")).alias("spans"),
        *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("n_live", "n_copied", "repos", "owners")],
    )


def _wide(spans: DataFrame, of: str, name: str) -> DataFrame:
    """value and how many distinct ones of a column hold it, exactly."""
    return spans.select("value", of).distinct().groupBy("value").agg(F.count(F.lit(1)).alias(name))


def values(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
           owner_col: str = "source") -> DataFrame:
    """Each candidate value's hash with its corpus-wide ownership: value_sha256, repos, owners, spans."""
    docs = pick(docs, id_col, text_col, repo_col, owner_col).toDF("doc_id", "text", "repo", "owner")
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.concat(
        F.filter(found(text, ASSIGN, 0), lambda s: F.length(s["value"]) >= 12),
        found(text, ACCESS, 1), found(text, HEX, 2),
    )
    rows = docs.select(F.col("repo").cast("string").alias("repo"), F.col("owner").cast("string").alias("owner"),
                       F.inline(spans))
    return (
        rows.groupBy(F.sha2("value", 256).alias("value_sha256"))
        .agg(F.count_distinct(F.coalesce("repo", F.lit("\x00"))).alias("repos"),
             F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("owners"),
             F.count(F.lit(1)).alias("spans"))
    )
