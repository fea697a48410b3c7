"""Secret scans with multipart credential linking, DataFrame functions only.

Base spans (assign, access, hex) come from one regular expression per kind. Weak candidates say little alone: a bare
40-character token, a client or key identifier, an endpoint. They are reported only when complementary parts stand in
the same scope, found by an interval join: parts are put into position buckets, every weak part covers the buckets of
its scope, and the equi-join on (document, bucket) is narrowed to the exact distance.

Positions are code points, end exclusive. They come from the text between matches (``split``) and the matches
themselves, added up in blocks, so that many matches in one text stay linear.

Defined results: null and empty texts have no spans (base_sha256 of the empty string); rows with the same id and text
share their spans; rows with the same id and other text are told apart; extra columns are ignored by ``scan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, written

#: Fixed values of the scan: kinds in the order in which ties at one start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = ASSIGN.replace("]+)", "]{8,})")
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
#: Weak parts, by class: identifier, secret, endpoint.
WEAK_ID = r"""(?i:client_?id|access_?key(?:_?id)?|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{6,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=_-])"
WEAK_ENDPOINT = r"""(?i)\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?)(://[^\x20\x09-\x0D"'<>]{4,})"""
KINDS = {"assign": (0, ASSIGN, 8), "access": (1, ACCESS, 16), "hex": (2, HEX, 32)}
WEAK = {"id": (3, WEAK_ID, 6), "token": (4, WEAK_SECRET, 40), "endpoint": (5, WEAK_ENDPOINT, 4)}
NAMES = {rank: name for name, (rank, _, _) in {**KINDS, **WEAK}.items()}
#: Code points between two parts of one credential, at most.
SCOPE = 200
_BLOCK = 64


def _lengths(texts: Column) -> Column:
    return F.transform(texts, F.length)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def spans_of(text: Column, rank: int, pattern: str, least: int, value: bool = False) -> Column:
    """array<struct<start, rank, end>> of the matches whose group 1 has ``least`` code points or more; with ``value``, of
    their group 1, which ends every match."""
    pat = F.lit(pattern)
    found = F.struct(
        F.regexp_extract_all(text, pat, F.lit(0)).alias("m"),
        _lengths(F.regexp_extract_all(text, pat, F.lit(1))).alias("v"),
        _lengths(F.split(text, pattern, -1)).alias("g"),
    )

    def places(f: Column) -> Column:
        n = F.size(f["m"])
        m = _lengths(f["m"])
        step = F.zip_with(F.slice(f["g"], F.lit(1), n), m, lambda g, x: F.struct(g.alias("g"), x.alias("m")))

        def from_steps(s: Column) -> Column:
            both = F.transform(s, lambda x: x["g"] + x["m"])
            return bind(both, lambda b: starts(s, b))

        def starts(s: Column, b: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")),
                lambda k: _total(F.slice(b, k * _BLOCK + 1, F.lit(_BLOCK))),
            )
            return bind(
                blocks,
                lambda sums: bind(
                    F.transform(sums, lambda _x, k: _total(F.slice(sums, F.lit(1), k))),
                    lambda before: F.transform(
                        s,
                        lambda x, i: F.struct(
                            (
                                F.get(before, F.floor(i / _BLOCK).cast("int"))
                                + _total(F.slice(b, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))
                                + x["g"]
                            ).alias("start"),
                            x["m"].alias("len"),
                        ),
                    ),
                ),
            )

        placed = bind(step, from_steps)
        kept = F.filter(
            F.zip_with(placed, f["v"], lambda p, v: F.struct(p["start"].alias("s"), p["len"].alias("l"), v.alias("v"))),
            lambda x: x["v"] >= least,
        )
        return F.transform(
            kept,
            lambda x: F.struct((x["s"] + x["l"] - x["v"] if value else x["s"]).alias("start"), F.lit(rank).alias("rank"), (x["s"] + x["l"]).alias("end")),
        )

    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    return F.when(text.rlike(pattern), bind(found, places)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""

    def one(x: Column) -> Column:
        kind = reduce(lambda c, r: c.when(x["rank"] == r, F.lit(NAMES[r])), sorted(NAMES)[1:], F.when(x["rank"] == 0, F.lit(NAMES[0])))
        return F.concat_ws(":", kind, x["start"].cast("string"), x["end"].cast("string"))

    return F.array_join(F.transform(spans, one), ",")


def linked_parts(docs: DataFrame, key: str, text: str, scope: int = SCOPE) -> DataFrame:
    """(_k, start, rank, end) of the weak parts whose complementary parts stand within ``scope`` code points.

    A weak token needs an identifier; a weak identifier needs a secret; an endpoint needs both. Access identifiers count
    as identifiers, assign and hex as secrets.
    """
    body = F.col(text)
    weak_here = reduce(lambda a, b: a | b, (body.rlike(p) for _, p, _ in WEAK.values()))
    every = F.concat(*[spans_of(body, *v) for v in (*KINDS.values(), *WEAK.values())])
    parts = (
        docs.where(weak_here)
        .select(_key(key, text), every.alias("p"))
        .where(F.size("p") > 1)
        .select("_k", F.explode("p").alias("p"))
        .select("_k", "p.start", "p.rank", "p.end")
        .distinct()
    )
    cls = F.when(F.col("rank").isin(1, 3), "i").when(F.col("rank") == 5, "e").otherwise("s")
    parts = written(docs.sparkSession, parts.withColumn("cls", cls), "parts")  # read five times below
    width = 2 * scope
    there = parts.where(F.col("cls") != "e").select(
        F.col("_k").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("cls").alias("c2"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("b2"),
    )
    weak = parts.where(F.col("rank") >= 3).withColumn(
        "b", F.explode(F.sequence(F.floor(F.greatest(F.col("start") - scope, F.lit(0)) / width), F.floor((F.col("end") + scope) / width)))
    )
    near = (F.col("_k") == F.col("k2")) & (F.col("b") == F.col("b2")) & (F.col("s2") <= F.col("end") + scope) & (F.col("e2") >= F.col("start") - scope)

    def beside(rows: DataFrame, wanted: str) -> DataFrame:
        return rows.join(there, near & (F.col("c2") == wanted), "left_semi")

    cols = ["_k", "start", "rank", "end"]
    token = beside(weak.where(F.col("rank") == 4), "i").select(cols)
    ident = beside(weak.where(F.col("rank") == 3), "s").select(cols)
    ends = weak.where(F.col("rank") == 5)
    end_i, end_s = beside(ends, "i").select(cols).distinct(), beside(ends, "s").select(cols).distinct()
    return token.union(ident).distinct().union(end_i.intersect(end_s))


def _key(key: str, text: str) -> Column:
    return F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.xxhash64(text).cast("string"), F.hash(text).cast("string")).alias("_k")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """key, base (array of spans), linked (array of spans): a row per row of ``docs``."""
    body = F.col(text)
    base = docs.select(
        F.col(key), _key(key, text),
        *[F.coalesce(spans_of(body, *v), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")).alias(k) for k, v in KINDS.items()],
    )
    more = (
        linked_parts(docs, key, text, scope)
        .groupBy("_k")
        .agg(F.collect_set(F.struct("start", "rank", "end")).alias("linked"))
        .withColumnRenamed("_k", "_k2")
    )
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")
    return base.join(more, F.col("_k") == F.col("_k2"), "left").select(
        key, *KINDS, F.sort_array(F.concat(*KINDS)).alias("base"), F.coalesce("linked", empty).alias("linked")
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the contract from the spans of ``scan``."""
    return found.select(
        key,
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "linked"))).alias("spans"),
    )


MASK = "[SECRET]"
#: Rows up to which the linked spans are broadcast to the texts; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def secret_values(text: Column) -> Column:
    """array<struct<start, end>> of what ``scan`` calls base spans, of assign spans the value alone.

    An assign match with a short value takes the text from one that starts in that value, so matches of long values are
    sought as well.
    """
    every = F.concat(*[spans_of(text, *v, value=True) for v in (*KINDS.values(), (0, ASSIGN_LONG, 8))])
    return F.transform(every, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with base spans and linked weak spans masked in the text; all rows and other columns stay as they are.

    All spans are places in the text as it came; spans that overlap get one mask.
    """
    spark = docs.sparkSession
    per = linked_parts(docs, key, text, scope).groupBy(F.col("_k").alias("_mk")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    per = written(spark, per, "linked")
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        per = F.broadcast(per)
    names = docs.columns
    rows = docs.select(F.struct("*").alias("_row"), _key(key, text)).join(per, F.col("_k") == F.col("_mk"), "left")
    body = F.col("_row")[text]

    def cut(a: Column, x: Column) -> Column:
        kept = F.concat(a["out"], F.array(F.substring(body, a["at"] + 1, x["start"] - a["at"]), F.lit(MASK)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], kept).otherwise(a["out"]).alias("out"))

    def masked(spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        done = F.aggregate(spans, start, cut, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, a["at"] + 1, F.length(body))))
        return F.when(F.size(spans) > 0, done).otherwise(body)

    linked = F.coalesce("_spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    new = bind(F.sort_array(F.array_distinct(F.concat(linked, secret_values(body)))), masked)
    return rows.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])
