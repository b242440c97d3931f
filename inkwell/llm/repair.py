"""Token ids in binary files compressed by Re-Pair grammars, with random access to documents.

A file is a Parquet part of blocks, one row each; a block's payload is self-contained (little-endian):

    b"RPAIR002", uint32 documents, uint32 rules, uint32 symbols, uint32 end
    int64  doc_id of each document          uint8  whether that id is null
    uint32 first symbol of each document    uint32 tokens of each document, the end id included
    uint32 left, uint32 right of each rule  uint32 expansion length of each rule
    uint32 symbols

Symbols below `end`, the size of the vocabulary, are token ids; `end` closes a document and stands for id 0; end + 1 + r
is rule r.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.shared import cut

MAGIC = b"RPAIR002"
#: Tokens after which a block is closed; a pair becomes a rule if it occurs so often: below, a rule costs more than it saves.
BLOCK, LEAST = 1 << 18, 12
#: Slots of the counts that rule out rare pairs, as a power of two.
SLOTS = 17
#: Encoded pieces that a worker keeps; bytes of text encoded at a time.
PIECES, BYTES = 400_000, 2 << 20

#: Classes of bytes. A is part of a character that is no white space, U of one that may be anything.
LETTER, DIGIT, MARK, QUOTE, SPACE, BLANK, A, U = range(8)


#: All Unicode white space is ASCII or starts with one of these bytes.
LEADS = (0xC2, 0xE1, 0xE2, 0xE3)


def _classes() -> np.ndarray:
    out = np.full(256, U, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else MARK
    out[32], out[9:14], out[128:] = SPACE, BLANK, A
    out[list(LEADS)] = U
    return out


def _flags() -> bytes:
    """By two classes: 1 if a byte-level pre-tokenizer surely splits between them, 2 for two white ones, 4 for U and BLANK."""
    out = np.zeros((8, 8), np.uint8)
    for x in (LETTER, DIGIT, MARK, QUOTE, A):
        out[x, [SPACE, BLANK]] = out[BLANK, x] = 1
    out[LETTER, [DIGIT, MARK, QUOTE]] = out[DIGIT, [LETTER, MARK, QUOTE]] = out[MARK, [LETTER, DIGIT]] = out[QUOTE, DIGIT] = 1
    out[SPACE : BLANK + 1, SPACE : BLANK + 1], out[U, BLANK] = 2, 4
    return bytes(np.resize(out.ravel(), 256))


#: Tables for bytes.translate, which needs no index of eight bytes for each.
CLASSES, FLAGS = _classes().tobytes(), _flags()


def classes(text: bytes) -> np.ndarray:
    """Each byte's class, both bytes of the letters from U+00C0 to U+00FF as those of others."""
    raw, kind = np.frombuffer(text, np.uint8), np.frombuffer(bytearray(text.translate(CLASSES)), np.uint8)
    at = np.flatnonzero(raw[:-1] == 0xC3)
    at = at[(raw[at + 1] != 0x97) & (raw[at + 1] != 0xB7)]
    kind[at] = kind[at + 1] = LETTER
    return kind


def boundaries(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Before which bytes of some joined texts, given their starts, the pre-tokenizer surely splits.

    A byte-level pre-tokenizer cuts a text into runs of letters, digits, marks and white space, each with the space
    before it; of several white characters before another, the last stands alone or is that space. Only boundaries
    that follow from the bytes next to them are told, so the pieces between them encode as they do in the text.
    """
    raw, kind = np.frombuffer(text, np.uint8), classes(text)
    lead = np.flatnonzero((kind == U) & (raw >= 0xC2))
    for k in (1, 2):
        at = lead[(lead + k < len(raw)) & (raw[lead] >= (0xE0 if k == 2 else 0))] + k
        kind[at] = U
    pair = kind[:-1] << 3 | kind[1:]
    flags = np.frombuffer(pair.tobytes().translate(FLAGS), np.uint8)
    out = np.zeros(len(raw), bool)
    np.equal(flags, 1, out=out[1:])
    known = lambda at: (kind[at] != U) & (kind[at] != SPACE) & (kind[at] != BLANK)
    # before the last of several white characters, which what follows must show; no text has the next one's bytes
    last = np.flatnonzero(flags == 2) + 1
    last = last[last < len(raw) - 1]
    begins = np.zeros(len(raw), bool)
    begins[starts] = True
    out[last[known(last + 1) & ~begins[last + 1]]] = True
    after = np.flatnonzero(flags == 4) + 2
    after = after[after < len(raw)]
    out[after[known(after)]] = False
    out[starts] = True
    return out


def ragged(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start : start + n] of each, joined."""
    end = np.cumsum(n)
    return flat[np.repeat(start - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


def sliced(values: pa.LargeBinaryArray) -> list[bytes]:
    """The values as bytes; several times faster than one scalar after another."""
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = values.buffers()[2].to_pybytes() if len(values) else b""
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


class Encoder:
    """Whole texts to token ids by the tokenizers library; each distinct piece between sure boundaries is encoded once.

    A text with an added token, and all texts for a tokenizer of another kind, are one piece.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import json

        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.end = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        split = kind.get("pre_tokenizer") or {}
        self.byte_level = not kind.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.added = [x["content"].encode() for x in kind.get("added_tokens", [])]
        # words are told apart by a character that none of them has, which the pre-tokenizer takes away
        self.listed = Tokenizer.from_file(path)
        if self.byte_level:
            self.listed.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            # how that vocabulary writes the bytes that words have, a character per byte
            self.written = np.zeros(256, "<u4")
            for c in map(chr, range(256)):
                self.written[list(c.encode())] = [ord(x) for x in split.pre_tokenize_str(c)[0][0]]
            self.written[ord("\n")] = ord("\n")
            self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.end)])
        self.known: dict[bytes, int] = {}
        self.flat, self.start, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # pieces met in a later batch than the one they were learnt in

    def forget(self, which: np.ndarray) -> np.ndarray:
        """Forget the pieces that no batch met again, or all but the given ones if that leaves too many; new numbers of those."""
        stay = self.again.copy()
        if np.count_nonzero(stay) > PIECES // 2:
            stay[:] = False
        stay[which[which >= 0]] = True
        old = np.flatnonzero(stay)
        number = np.full(len(stay) + 1, -1)  # the last one for pieces not known
        number[old] = np.arange(len(old))
        pieces = list(self.known)
        self.known = {pieces[k]: i for i, k in enumerate(old.tolist())}
        self.flat, self.n = ragged(self.flat, self.start[old], self.n[old]), self.n[old]
        self.start, self.again = np.cumsum(self.n) - self.n, np.zeros(len(old), bool)
        return number[which]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces: words, which nothing splits, many in one text and told apart by their bytes; others one by one.

        Returns their numbers.
        """
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        word = np.zeros(len(pieces), bool)
        if self.byte_level and pieces:
            joined, at = b"".join(pieces), np.cumsum(size) - size
            space = np.frombuffer(joined, np.uint8)[at] == ord(" ")
            word = (np.add.reduceat(classes(joined) != LETTER, at, dtype=np.int64) == space) & (size > space)
        words, others = np.flatnonzero(word), np.flatnonzero(~word)
        flat, n = [self.flat], [self.n]
        for low in range(0, len(words), 20_000):
            some = words[low : low + 20_000]
            raw = np.frombuffer(b"\n".join([pieces[i] for i in some.tolist()]), np.uint8)
            ids = np.array(self.listed.encode_batch_fast([self.written[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(size[some])) + 1
            flat.append(ids)
            n.append(np.diff(ends, prepend=0))
        each = self.ids([pieces[i].decode() for i in others.tolist()])
        order, first = np.concatenate((words, others)), len(self.known)
        self.known.update((pieces[k], first + i) for i, k in enumerate(order.tolist()))
        self.flat, self.n = np.concatenate(flat + each), np.concatenate([*n, np.fromiter(map(len, each), np.int64, len(each))])
        self.start, self.again = np.cumsum(self.n) - self.n, np.append(self.again, np.zeros(len(pieces), bool))
        number = np.empty(len(pieces), np.int64)
        number[order] = first + np.arange(len(pieces))
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (binary, without nulls) joined, `end` after each, and how many each has with that."""
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None else b""
        at = offsets - offsets[0]
        first = at[:-1][at[:-1] < at[1:]]  # of texts that aren't empty
        if self.byte_level:
            is_cut = boundaries(raw, first)
            for token in self.added:
                i = raw.find(token)
                while i >= 0:
                    t = int(np.searchsorted(at, i, "right"))
                    is_cut[at[t - 1] + 1 : at[t]] = False
                    i = raw.find(token, i + 1)
            cuts = np.flatnonzero(is_cut)
        else:
            cuts = first
        slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
        table = slices.dictionary_encode()
        pieces = sliced(table.dictionary)
        which = np.fromiter(map(self.known.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        self.again[which[which >= 0]] = True
        if len(self.known) > PIECES:
            which = self.forget(which)
        new = np.flatnonzero(which < 0)
        which[new] = self.learn([pieces[i] for i in new.tolist()])
        which = which[table.indices.to_numpy()]
        n = self.n[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        ends = upto[np.searchsorted(cuts, at[1:])]
        out = np.insert(ragged(self.flat, self.start[which], n), ends, self.end)
        return out, np.diff(ends, prepend=0) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def sizes(symbols: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(symbols.shape, np.int64)
    rule = symbols > end
    out[rule] = lengths[symbols[rule] - (end + 1)]
    return out


def compress(seq: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (uint32, `end` between documents) -> shorter symbols, rules (n, 2) and the rules' expansion lengths.

    A round counts the pairs that may have become frequent and replaces them together; where two pairs overlap the
    more frequent one goes first, and a pair that keeps fewer than LEAST places waits for the next round. Rounds go on
    until no pair occurs LEAST times; the most frequent pair is replaced in each, so they end. Pairs never hold `end`.
    """
    seq = seq.astype(np.uint32)
    rules, lengths, top = [np.zeros((0, 2), np.uint32)], np.zeros(0, np.int64), end + 1
    live = np.ones(len(seq), bool)  # the pair that starts here may be frequent
    while len(seq) > 1:
        live[-1] = False
        live[:-1] &= (seq[:-1] != end) & (seq[1:] != end)
        starts = live.copy()
        place = np.flatnonzero(live[:-1] & (seq[:-1] == seq[1:]))
        if len(place):  # in a run of one symbol every other pair counts
            first = np.concatenate(([True], place[1:] != place[:-1] + 1))
            starts[place[(place - place[np.flatnonzero(first)][np.cumsum(first) - 1]) % 2 == 1]] = False
        at = np.flatnonzero(starts)
        bits = int(top).bit_length()
        pair = seq[at].astype(np.uint64) << np.uint64(bits) | seq[at + 1]
        slot = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        often = (np.bincount(slot, minlength=1 << SLOTS) >= LEAST)[slot]  # pairs may share a slot: none is missed
        live[at[~often]] = False
        at, pair = at[often], pair[often]
        width = int(len(seq)).bit_length()
        if 2 * bits + width <= 64:
            both = np.sort(pair << np.uint64(width) | at.astype(np.uint64))
            pair, at = both >> np.uint64(width), (both & np.uint64((1 << width) - 1)).astype(np.int64)
        else:
            order = np.argsort(pair, kind="stable")
            pair, at = pair[order], at[order]
        edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
        count = np.diff(np.append(edge, len(pair)))
        order = np.argsort(count, kind="stable")
        rank = np.zeros(len(edge), np.int32)
        rank[order] = np.arange(1, len(edge) + 1)
        rank[count < LEAST] = 0
        of = np.repeat(rank, count)
        live[at] = of > 0
        if not (count >= LEAST).any():
            break
        place = np.zeros(len(seq) + 2, np.int32)
        place[at + 1] = of
        at = np.flatnonzero((place[1:-1] > place[:-2]) & (place[1:-1] > place[2:]))
        rank = place[at + 1] - 1
        won = np.bincount(rank, minlength=len(edge))
        made = np.flatnonzero(won >= LEAST)
        name = np.zeros(len(edge), np.uint32)
        name[made] = top + np.arange(len(made))
        taken = won[rank] >= LEAST
        at, rank, made = at[taken], rank[taken], order[made]
        new = np.stack((pair[edge[made]] >> np.uint64(bits), pair[edge[made]] & np.uint64((1 << bits) - 1)), axis=1).astype(np.uint32)
        rules.append(new)
        lengths = np.concatenate((lengths, sizes(new, lengths, end).sum(axis=1)))
        top += len(made)
        seq[at] = name[rank]
        live[at] = True
        live[at[at > 0] - 1] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        # the pair before a replaced one may start with a symbol that this round replaced as well
        live[at[at > 1] - 2] |= ~stay[at[at > 1] - 1]
        seq, live = seq[stay], live[stay]
    return seq, np.concatenate(rules), lengths


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """Symbols back to token ids (uint32), `end` as 0. A rule's halves are put where its expansion begins and so on."""
    n = sizes(seq, lengths, end)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint32)
    while len(seq):
        leaf = seq <= end
        out[at[leaf]] = seq[leaf]
        seq, at = seq[~leaf], at[~leaf]
        left, right = rules[seq - (end + 1)].T
        seq, at = np.concatenate((left, right)), np.concatenate((at, at + sizes(left, lengths, end)))
    out[out == end] = 0
    return out


def pack(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, end: int) -> bytes:
    """A block of documents by their token ids, joined with `end` after each, and how many each has with that."""
    seq, rules, lengths = compress(ids, end)
    first = np.concatenate(([0], np.flatnonzero(seq == end)[:-1] + 1)).astype("<u4")
    head = MAGIC + struct.pack("<4I", len(doc_ids), len(rules), len(seq), end)
    parts = (np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), first, counts.astype("<u4"), rules.T.astype("<u4"), lengths.astype("<u4"), seq.astype("<u4"))
    return head + b"".join(x.tobytes() for x in parts)


class Block:
    """A block as read: decode(i) reads one document, expanding only its own symbols."""

    def __init__(self, payload: bytes) -> None:
        if payload[:8] != MAGIC:
            raise ValueError("not a Re-Pair block")
        n, r, m, self.end = struct.unpack_from("<4I", payload, 8)
        at = 24

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.first, self.counts = take("<i8", n), take("u1", n), take("<u4", n), take("<u4", n)
        self.rules = take("<u4", 2 * r).reshape(2, r).T
        self.lengths, self.seq = take("<u4", r), take("<u4", m)

    def decode(self, i: int) -> np.ndarray:
        stop = self.first[i + 1] if i + 1 < len(self.first) else len(self.seq)
        return expand(self.seq[self.first[i] : stop], self.rules, self.lengths, self.end)

    def decode_all(self) -> list[np.ndarray]:
        return np.split(expand(self.seq, self.rules, self.lengths, self.end), np.cumsum(self.counts, dtype=np.int64)[:-1])


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode docs (doc_id, text) in ascending doc_id order into blocks; returns the files as read back.

    Rows (shard, before, n_docs, n_tokens, payload), `before` being the tokens of the shard's blocks before. One shuffle deals texts by ranges of doc_id; a task then holds one
    block at a time. Null text: empty. Null ids come first. Ties of doc_id go by text; repeated rows stay.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        before, held, who, counts, tokens = 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = pack(who, np.concatenate(held), np.concatenate(counts), encode.end)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(who)], pa.int32()), pa.array([tokens], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "before", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            doc_ids, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            while at < batch.num_rows:
                past = upto[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(upto, past + BYTES, "right")))
                ids, n = encode.encode(texts.slice(at, stop - at))
                ends, low = np.cumsum(n), 0
                while low < len(n):
                    done = ends[low - 1] if low else 0
                    high = min(len(n), int(np.searchsorted(ends, done + BLOCK - tokens)) + 1)
                    held.append(ids[done : ends[high - 1]])
                    counts.append(n[low:high])
                    who += doc_ids[at + low : at + high]
                    tokens += int(ends[high - 1] - done)
                    low = high
                    if tokens >= BLOCK:
                        yield row()
                        before, held, who, counts, tokens = before + tokens, [], [], [], 0
                at = stop
        if who:
            yield row()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return cut(dealt.mapInArrow(step, "shard int, before long, n_docs int, n_tokens long, payload binary"), "tokens")


def read_digest(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in the order of the files."""
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row per task that wrote, so that no payload is shuffled
    base = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in block.decode_all()]
                counts = block.counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, mask=block.null.astype(bool)), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(F.broadcast(base), "shard").select((F.col("base") + F.col("before")).alias("start"), "payload").mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files and read them back: doc_id, start, n_tokens, ids_crc32 (see write_tokens).

    An empty table gives no file and no row; an empty text is its end id alone. Only doc_id and text are read.
    """
    return read_digest(write_tokens(docs, tokenizer))
