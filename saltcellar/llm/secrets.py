"""Secret scans with corpus-wide ownership frequencies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltcellar.llm.shared import stored, text_of


class Kind(NamedTuple):
    name: str
    pattern: str
    group: int  # whose text is the secret
    least: int  # characters of it
    hint: str | None  # stands in every text with a match; None: the pattern itself decides


# Fixed values. The first three are the base kinds; in theirs, least lengths inside a greedy run are written into the pattern where
# that finds the same matches.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, None),
    Kind("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16, None),
)
FURTHER = (
    Kind("forge", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30, "eyJ"),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Kind("private", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27, "PRIVATE KEY-----"),
    Kind("login", r"[a-z]{3,10}://[^\s/:@]{1,64}:([^\s/:@]{6,64})@", 1, 6, "://"),
)
KINDS = BASE + FURTHER
COPIED_OWNERS = 3
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,secret:string>>"


def _spans_of(text: Column, rank: int, kind: Kind) -> Column:
    """Spans of one kind, leftmost and not overlapping: what stands between matches gives the places.

    A secret is kept as its SHA-256 only.
    """
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    secret = whole if kind.group == 0 else F.regexp_extract_all(text, pattern, F.lit(kind.group))
    parts = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), whole.alias("whole"), secret.alias("secret"))
    none = F.array().cast(_SPAN)

    def add(held: Column, part: Column) -> Column:
        start = held["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["whole"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind.name).alias("kind"), F.sha2(part["secret"], 256).alias("secret")
        )
        kept = F.when(F.char_length(part["secret"]) >= kind.least, F.concat(held["found"], F.array(span))).otherwise(held["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda held: held["found"])
    likely = F.rlike(text, pattern)
    if kind.hint:
        likely = F.contains(text, F.lit(kind.hint)) & likely
    return F.when(likely, found).otherwise(none)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(documents: DataFrame, key: str = "doc_id", owner: str = "source") -> DataFrame:
    """(key, owner, row, spans) of every row: all spans of the whole text by start, then kind; null text is empty text."""
    text = text_of("text")
    rows = documents.select(F.col(key).alias("doc"), F.col(owner).alias("owner"), F.xxhash64(F.col(key), text).alias("row"), text.alias("text"))
    by_kind = rows.select("doc", "owner", "row", *[_spans_of(F.col("text"), i, k).alias(k.name) for i, k in enumerate(KINDS)])
    return by_kind.select("doc", "owner", "row", F.sort_array(F.concat(*[k.name for k in KINDS])).alias("spans"))


def ownership(candidates: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(secret, repositories, owners, copied) from rows (secret, repository, owner); null counts as a repository or an owner.

    Rows are made distinct before they meet, so a secret that stands everywhere is combined where it is read.
    """
    seen = candidates.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = seen.groupBy("secret", "owner").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count("one").alias("owners"))
    places = seen.groupBy("secret", "repository").agg(F.lit(1).alias("one")).groupBy("secret").agg(F.count("one").alias("repositories"))
    return owners.join(places, "secret").withColumn("copied", F.col("owners") >= copied_owners)


def scan(documents: DataFrame, key: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Secrets of every row of `documents`: key, n_assign, n_access, n_hex, base_sha256, spans, n_further, n_copied, n_own.

    A document is a repository, its source the owner. A secret (by its SHA-256) that `copied_owners` or more owners have is a
    copied example (n_copied); others are specific to their owner and may be live (n_own). Both count spans of all kinds.
    Null and empty texts have no span. Rows that repeat key and text have equal results; an empty table has none. Only
    the key, the text and the owner are read.
    """
    found = stored(find_secrets(documents, key, owner), "secrets")
    spans = found.select("doc", "owner", "row", F.inline("spans")).distinct()
    spans = spans.select("doc", "owner", "row", "start", "rank", "secret")
    known = ownership(spans.select("secret", F.col("doc").alias("repository"), "owner"), copied_owners).select("secret", "copied")
    judged = spans.drop("owner").distinct().join(known, "secret").groupBy("doc", "row").agg(
        F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied")).alias("n_own")
    )
    judged = judged.select(F.col("doc").alias("of"), F.col("row").alias("of_row"), "n_copied", "n_own")
    joined = found.join(judged, F.col("doc").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    ranks = F.transform("spans", lambda s: s["rank"])
    number = {k.name: F.size(ranks) - F.size(F.array_remove(ranks, i)) for i, k in enumerate(BASE)}
    return joined.select(
        F.col("doc").alias(key), *[number[k.name].cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_further"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_own", F.lit(0)).alias("n_own"),
    )
