"""Integer codecs for postings: gaps, variable bytes, Elias gamma and delta. Sizes are expressions; bytes are Arrow UDFs.

Every codec has encode and decode for ascending ids and encode_tf and decode_tf for frequencies. An empty list is empty
bytes.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from itertools import accumulate

import pandas as pd
from inkwell.functions.weights import delta_bits, gamma_bits, vbyte_bytes
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values above this take a delta code in the adaptive codec.
CROSSOVER = 16


def gaps(ids: Iterable[int]) -> list[int]:
    """The first id, then differences."""
    ids = [int(x) for x in ids]
    return [b - a for a, b in zip([0, *ids], ids, strict=False)]


def bits(values: Iterable[str]) -> bytes:
    """Bit strings packed behind a 4-byte big-endian count of their bits, zero-padded at the end."""
    joined = "".join(values)
    if not joined:
        return b""
    return len(joined).to_bytes(4, "big") + int(joined.ljust(-(-len(joined) // 8) * 8, "0"), 2).to_bytes(-(-len(joined) // 8), "big")


class Bits:
    """A reader of what bits() packs."""

    def __init__(self, data: bytes) -> None:
        n = int.from_bytes(data[:4], "big")
        self.text = f"{int.from_bytes(data[4:], 'big'):0{8 * (len(data) - 4)}b}"[:n] if data else ""
        self.at = 0

    def take(self, n: int) -> str:
        self.at += n
        return self.text[self.at - n : self.at]

    def gamma(self) -> int:
        zeros = self.text.index("1", self.at) - self.at
        self.at += zeros
        return int(self.take(zeros + 1), 2)

    def delta(self) -> int:
        k = self.gamma() - 1
        return int("1" + self.take(k), 2)

    def all(self, read: Callable[[], int]) -> list[int]:
        out = []
        while self.at < len(self.text):
            out.append(read())
        return out


def gamma(x: int) -> str:
    return "0" * (x.bit_length() - 1) + f"{x:b}"


def delta(x: int) -> str:
    return gamma(x.bit_length()) + f"{x:b}"[1:]


def vbyte(values: Iterable[int]) -> bytes:
    """Seven bits a byte, most significant first; the high bit marks a number's last byte."""
    out = bytearray()
    for x in values:
        part = [x & 127 | 128]
        while x := x >> 7:
            part.append(x & 127)
        out += bytes(reversed(part))
    return bytes(out)


def unvbyte(data: bytes) -> list[int]:
    out, x = [], 0
    for byte in data:
        x = x << 7 | byte & 127
        if byte & 128:
            out.append(x)
            x = 0
    return out


def fixed(values: Iterable[int]) -> bytes:
    return b"".join(int(x).to_bytes(8, "little") for x in values)


def unfixed(data: bytes) -> list[int]:
    return [int.from_bytes(data[i : i + 8], "little") for i in range(0, len(data), 8)]


def plus(values: Iterable[int]) -> list[int]:
    return [int(x) + 1 for x in values]


def minus(values: Iterable[int]) -> list[int]:
    return [x - 1 for x in values]


def adaptive(x: int) -> str:
    return "0" + gamma(x) if x <= CROSSOVER else "1" + delta(x)


def unadaptive(data: bytes) -> list[int]:
    r = Bits(data)
    return r.all(lambda: r.delta() if r.take(1) == "1" else r.gamma())


def ungamma(data: bytes) -> list[int]:
    r = Bits(data)
    return r.all(r.gamma)


class Codec:
    def __init__(self, name: str, ids: tuple[Callable, Callable], tfs: tuple[Callable, Callable], bits_: tuple[Callable[[Column], Column], Callable[[Column], Column]], header: tuple[int, int]) -> None:
        self.name, self.header = name, header
        self.encode, self.decode = ids
        self.encode_tf, self.decode_tf = tfs
        self.gap_bits, self.tf_bits = bits_


def _gamma_tf(tf: Column) -> Column:
    return gamma_bits(tf + 1)


_gamma_tfs = (lambda t: bits(map(gamma, plus(t))), lambda b: minus(ungamma(b)))
_vbyte_ids = (lambda p: vbyte(gaps(p)), lambda b: list(accumulate(unvbyte(b))))

CODECS: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("standard", (fixed, unfixed), (fixed, unfixed), (lambda g: F.lit(64), lambda t: F.lit(64)), (0, 0)),
        Codec("vbe", _vbyte_ids, (lambda t: vbyte(map(int, t)), unvbyte), (lambda g: 8 * vbyte_bytes(g), lambda t: 8 * vbyte_bytes(t)), (0, 0)),
        Codec("elias", (lambda p: bits(map(gamma, plus(gaps(p)))), lambda b: list(accumulate(minus(ungamma(b))))), _gamma_tfs, (lambda g: gamma_bits(g + 1), _gamma_tf), (4, 4)),
        Codec("eg-delta", (lambda p: bits(map(adaptive, plus(gaps(p)))), lambda b: list(accumulate(minus(unadaptive(b))))), _gamma_tfs, (lambda g: 1 + F.when(g + 1 <= CROSSOVER, gamma_bits(g + 1)).otherwise(delta_bits(g + 1)), _gamma_tf), (4, 4)),
        Codec("vbe-eg-tf", _vbyte_ids, _gamma_tfs, (lambda g: 8 * vbyte_bytes(g), _gamma_tf), (0, 4)),
    )
}


#: doc_ids of the ranges in which a term's list is worked on.
CHUNK = 1 << 20


def with_gaps(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """postings with gap: doc_id less the one before in the term's list, the first one whole.

    A term's list is worked on in ranges of `chunk` doc_ids, each of which learns the last doc_id before it, so that a
    term that most documents have is many tasks' work.
    """
    rows = postings.withColumn("__part", F.floor(F.col("doc_id") / chunk).cast("long"))
    last = rows.groupBy("term", "__part").agg(F.max("doc_id").alias("__last"))
    ahead = last.select("term", "__part", F.lag("__last").over(Window.partitionBy("term").orderBy("__part")).alias("__ahead")).where("__ahead is not null")
    rows = rows.withColumn("__before", F.lag("doc_id").over(Window.partitionBy("term", "__part").orderBy("doc_id")))
    rows = rows.join(ahead, ["term", "__part"], "left")
    return rows.select(*[F.col(c) for c in postings.columns], (F.col("doc_id") - F.coalesce("__before", "__ahead", F.lit(0))).alias("gap"))


def from_gaps(rows: DataFrame) -> DataFrame:
    """(term, pos, gap) -> doc_id by a running sum."""
    w = Window.partitionBy("term").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("doc_id", F.sum("gap").over(w))


def sizes(postings: DataFrame, codecs: list[str] | None = None) -> DataFrame:
    """(codec, term, n, bytes): what each codec takes for a term's ids and frequencies, by arithmetic alone."""
    names = codecs or list(CODECS)
    g, t = F.col("gap"), F.col("tf").cast("long")
    sums = [f(CODECS[n])(x) for n in names for f, x in ((lambda c: c.gap_bits, g), (lambda c: c.tf_bits, t))]
    rows = with_gaps(postings).groupBy("term").agg(F.count("*").alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)])
    each = []
    for i, name in enumerate(names):
        head = CODECS[name].header
        total = F.ceil(F.col(f"s{2 * i}") / 8) + F.ceil(F.col(f"s{2 * i + 1}") / 8) + sum(head)
        each.append(F.struct(F.lit(name).alias("codec"), total.cast("long").alias("bytes")))
    return rows.select("term", "n", F.explode(F.array(*each)).alias("x")).select("x.codec", "term", "n", "x.bytes")


def size_report(postings: DataFrame, codecs: list[str] | None = None) -> DataFrame:
    """(codec, postings, bytes, ratio to 16 bytes a posting)."""
    s = sizes(postings, codecs).groupBy("codec").agg(F.sum("n").alias("postings"), F.sum("bytes").alias("bytes"))
    return s.select("codec", "postings", "bytes", (F.col("postings") * 16 / F.col("bytes")).alias("ratio"))


def tf_histogram(postings: DataFrame, k: int = 15) -> DataFrame:
    """The k least tf values: (tf, postings, gamma_bits of tf + 1, vbyte_bits)."""
    rows = postings.groupBy("tf").agg(F.count("*").alias("postings")).orderBy("tf").limit(k)
    return rows.select("tf", "postings", gamma_bits(F.col("tf") + 1).alias("gamma_bits"), (8 * vbyte_bytes(F.col("tf"))).alias("vbyte_bits"))


def udfs(name: str) -> dict[str, Callable[[Column], Column]]:
    """encode, decode, encode_tf, decode_tf of a codec as pandas UDFs between array<bigint> and binary."""
    c = CODECS[name]

    def make(f: Callable, kind: str) -> Callable[[Column], Column]:
        @F.pandas_udf(kind)
        def over(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x))

        return over

    return {"encode": make(c.encode, "binary"), "decode": make(c.decode, "array<bigint>"), "encode_tf": make(c.encode_tf, "binary"), "decode_tf": make(c.decode_tf, "array<bigint>")}


def encoded(lists: DataFrame, name: str) -> DataFrame:
    """(term, list of (doc_id, tf)) -> (term, ids, tfs) in the codec's bytes."""
    u = udfs(name)
    return lists.select("term", u["encode"](F.col("list.doc_id")).alias("ids"), u["encode_tf"](F.col("list.tf").cast("array<bigint>")).alias("tfs"))


def roundtrip(postings: DataFrame, names: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(codec, lists, bytes, wrong): encodes and decodes every list; wrong counts those that come back unlike.

    A list holds a term's postings in a range of `chunk` doc_ids. All codecs go over the lists in one pass.
    """
    from inkwell.operators.index import packed

    p, t = F.col("list.doc_id"), F.col("list.tf").cast("array<bigint>")
    rows, each = packed(postings, chunk).select(p.alias("p"), t.alias("t")), []
    names = names or list(CODECS)
    for i, name in enumerate(names):
        u = udfs(name)
        rows = rows.withColumns({f"i{i}": u["encode"](F.col("p")), f"t{i}": u["encode_tf"](F.col("t"))})
        each.append((name, u["decode"](F.col(f"i{i}")), u["decode_tf"](F.col(f"t{i}")), F.octet_length(f"i{i}") + F.octet_length(f"t{i}")))
    for i, (_, p2, t2, _) in enumerate(each):
        rows = rows.withColumns({f"p{i}": p2, f"u{i}": t2})
    told = [F.struct(F.lit(name).alias("codec"), n.cast("long").alias("bytes"), ((F.col("p") != F.col(f"p{i}")) | (F.col("t") != F.col(f"u{i}"))).alias("unlike")) for i, (name, _, _, n) in enumerate(each)]
    rows = rows.select(F.explode(F.array(*told)).alias("x")).select("x.*")
    return rows.groupBy("codec").agg(F.count("*").alias("lists"), F.sum("bytes").cast("long").alias("bytes"), F.count_if("unlike").alias("wrong"))


def speeds(lists: list[tuple[list[int], list[int]]], names: list[str] | None = None) -> list[dict]:
    """Seconds to encode and decode (ids, tfs) lists in this process, millions of integers a second, and the bytes."""
    out = []
    total = sum(len(p) + len(t) for p, t in lists)
    for name in names or list(CODECS):
        c = CODECS[name]
        began = time.perf_counter()
        data = [(c.encode(p), c.encode_tf(t)) for p, t in lists]
        middle = time.perf_counter()
        same = [(c.decode(a), c.decode_tf(b)) for a, b in data] == [(list(p), list(t)) for p, t in lists]
        end = time.perf_counter()
        made = sum(len(a) + len(b) for a, b in data)
        out.append({"codec": name, "bytes": made, "ratio": 8 * total / max(1, made), "encode_s": middle - began, "decode_s": end - middle, "encode_m_ints_s": total / 1e6 / max(1e-9, middle - began), "decode_m_ints_s": total / 1e6 / max(1e-9, end - middle), "same": same})
    return out


def synthetic_postings(spark, terms: int = 500, most_docs: int = 200, seed: int = 42) -> DataFrame:
    """Postings with gaps of 1 to 50 and tf 1, 2, 3 to 5 and 6 to 20 at 60, 25, 10 and 5 %."""
    rows = spark.range(terms).withColumn("n", (1 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most_docs))).cast("int"))
    rows = rows.select(F.format_string("term%06d", "id").alias("term"), F.explode(F.sequence(F.lit(1), "n")).alias("pos"))
    u = lambda salt: F.pmod(F.xxhash64("term", "pos", F.lit(seed + salt)), F.lit(100))
    tf = F.when(u(1) < 60, 1).when(u(1) < 85, 2).when(u(1) < 95, 3 + F.pmod(u(2), F.lit(3))).otherwise(6 + F.pmod(u(2), F.lit(15)))
    rows = rows.select("term", "pos", (1 + F.pmod(u(3), F.lit(50))).alias("gap"), tf.cast("int").alias("tf"))
    return from_gaps(rows).select("term", "doc_id", "tf")
