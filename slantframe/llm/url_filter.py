"""URL verdicts by rules and, where no rule fits, by a Bloom filter cascade.

A cascade holds exactly the listed ones of a known universe of keys.  Level 0
encodes the listed keys; the keys of the universe that pass although they are
not listed go into level 1; the listed keys that pass level 1 as well go into
level 2, and so on until a level lets nothing through by mistake.  A key's
membership follows from the first level that stops it.  The universe is every
key of the corpus, so the answer is exact for every row and rows are judged
where they lie, without a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slantframe.llm.scratch import Scratch

#: Bits of a level for each of its keys, and hash functions.
BITS, HASHES = 10, 4
#: The cascade is broadcast while all of its levels fit in so many bytes; beyond it, rows are joined with the listed keys.
MOST_BYTES = 64 << 20
#: Bits that one row of a collected level holds.
WORD = 1 << 15


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that start with path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name).otherwise(name)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _places(level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + i), F.col("key")), F.lit(bits)) for i in range(HASHES)]


@dataclass(frozen=True)
class Cascade:
    """The levels as bit arrays; even levels encode listed keys."""

    levels: tuple[np.ndarray, ...]

    def sizes(self) -> list[int]:
        return [len(x) * 8 for x in self.levels]


def _passes(levels: Sequence[np.ndarray], places: np.ndarray, first: int) -> np.ndarray:
    """For each key the number of levels from first on that it passes before one stops it."""
    alive = np.ones(len(places), dtype=bool)
    out = np.zeros(len(places), dtype=np.int32)
    for k, bits in enumerate(levels):
        own = places[:, k * HASHES : (k + 1) * HASHES]
        alive = alive & np.all(bits[own >> 3] >> (own & 7).astype(np.uint8) & 1, axis=1)
        out += alive
    return out + first


def passed(df: DataFrame, levels: Sequence[np.ndarray], first: int = 0) -> DataFrame:
    """df (with a column key) and the column passed: levels that let the key through, from first on."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(levels))
    places = F.array(*[p for k, bits in enumerate(levels) for p in _places(first + k, len(bits) * 8)])
    out = df.withColumn("__places", places)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "passed int"])
    width, names = len(levels) * HASHES, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_passes(shared.value, own, first))], [*names, "passed"])

    return out.mapInArrow(run, schema)


def _level(keys: DataFrame, number: int, n: int) -> np.ndarray:
    """The bit array of n keys; rows of at most WORD bits reach the driver, each once."""
    size = max(64, -(-n * BITS // 64) * 64)
    places = keys.select(F.explode(F.array(*_places(number, size))).alias("p")).select(F.expr(f"p div {WORD}").alias("word"), (F.col("p") % WORD).cast("int").alias("bit"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            word, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for w in np.unique(word):
                bits = found.setdefault(int(w), np.zeros(WORD, dtype=bool))
                bits[bit[word == w]] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([np.packbits(b, bitorder="little").tobytes() for b in found.values()], pa.binary())], ["word", "bits"])

    out = np.zeros((size + 7) // 8 + WORD // 8, dtype=np.uint8)
    spread = places.repartition("word").mapInArrow(packed, "word long, bits binary")
    for word, bits in spread.collect():
        at = word * (WORD // 8)
        out[at : at + len(bits)] |= np.frombuffer(bits, dtype=np.uint8)
    return out[: size // 8]


def build_cascade(universe: DataFrame, listed: DataFrame, most_bytes: int = MOST_BYTES) -> Cascade | None:
    """The cascade of the listed keys among all keys; None if it would be larger than most_bytes.

    universe and listed have a column key; repeated and null keys count once
    and not at all.  Listed keys outside the universe are left out.
    """
    scratch = Scratch(universe.sparkSession, "cascade")
    universe = universe.select("key").where("key is not null").distinct()
    listed = listed.select("key").where("key is not null").distinct()
    flagged = scratch.save(universe.join(listed.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    levels: list[np.ndarray] = []
    inside, outside = flagged.where("listed").select("key"), flagged.where("not listed").select("key")
    saved = [flagged]
    while True:
        n = inside.count()
        if not n and levels:
            break
        if (n * BITS) // 8 + sum(map(len, levels)) > most_bytes:
            scratch.drop(*saved)
            return None
        levels.append(_level(inside, len(levels), n))
        let = scratch.save(passed(outside, levels[-1:], len(levels) - 1).where(F.col("passed") == len(levels)).select("key"))
        saved.append(let)
        inside, outside = let, inside
    scratch.drop(*saved)
    return Cascade(tuple(levels))


def parent_domains(host: Column) -> Column:
    """The host and what is left of it as its leading labels go, one by one."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def worded_hosts(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """(key): every domain of pages whose first label holds one of the words between hyphens."""
    key = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct().select(F.explode(parent_domains(F.col("host"))).alias("key")).distinct()
    return key.where(F.arrays_overlap(F.split(F.substring_index("key", ".", 1), "-", -1), F.array(*[F.lit(w) for w in words])))


def tracked_hosts(pages: DataFrame, times: float = 1.0) -> DataFrame:
    """(key): the hosts of pages that carry tracking parameters (utm_...) in a larger share of their urls than ``times`` that of all pages."""
    tracked = F.coalesce(F.col("url").rlike("[?&]utm_"), F.lit(False)).cast("long")
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("key"), tracked.alias("tracked")).groupBy("key").agg(F.sum("tracked").alias("own"), F.count("*").alias("urls"))
    every = pages.agg(F.sum(tracked), F.count("*")).first()
    # Whole numbers on both sides, so that equal shares are equal.
    return hosts.where((F.col("key") != "") & (F.col("own") * F.lit(every[1]) > F.col("urls") * F.lit(every[0] or 0) * F.lit(times))).select("key")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, most_bytes: int = MOST_BYTES, parents: bool = False) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    verdict is the longest fitting rule's; where none fits, block if the host
    is listed (column key of listed) and allow otherwise.  With parents, a
    host is also blocked if a domain above it is listed.  A null url, or one
    without ://, has an empty host and path; an empty host is listed only if
    the empty string is.  Repeated rows give a row each; other columns are not
    looked at.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    keys = parsed.select(F.col("host").alias("key"))
    if parents:
        # The hosts at or below a listed domain are the listed keys, so rows are still judged by their own host alone.
        under = keys.distinct().select("key", F.explode(parent_domains(F.col("key"))).alias("domain"))
        listed = under.join(listed.select(F.col("key").alias("domain")).distinct(), "domain", "left_semi").select("key").distinct()
    cascade = build_cascade(keys, listed, most_bytes)
    name, verdict = fitting_rule(rules, F.col("host"), F.col("path"))
    if cascade is None:
        flags = listed.select("key").distinct().withColumn("passed", F.lit(1))
        judged = parsed.withColumn("key", F.col("host")).join(flags, "key", "left").fillna(0, ["passed"])
    else:
        judged = passed(parsed.withColumn("key", F.col("host")), cascade.levels)
    own = F.when(F.col("passed") % 2 == 1, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))
