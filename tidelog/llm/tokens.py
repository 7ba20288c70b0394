"""Token ids in a binary file format with Re-Pair grammar compression.

Documents are laid out in ascending doc_id order, cut into blocks of about ``block_tokens`` ids. Within a block, rounds
of Re-Pair replace frequent pairs of neighbouring ids by nonterminals until no pair earns a rule any more; a pair never
spans two documents. A block is one self-contained record, so a reader decodes any document from the block's rules alone:

    "RPG2", then little-endian: documents u32, rules u32, symbols u32, first nonterminal u32, width of a symbol u32,
    doc_ids i64[documents] (null flags u8[documents] after them), tokens u32[documents], symbols u32[documents],
    rules symbol[rules][2], expansion lengths u32[rules], symbols symbol[symbols]; all but "RPG2" as one Zstandard frame.

A symbol is u16 while the vocabulary and the block's rules fit in it, else u32. Records are rows of a Parquet dataset in
the shared folder, which any store that Spark writes to can hold.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_blocks

_CACHE_RUNS = 1_000_000
_BLOCK = 4 << 20  # bytes of text encoded at a time
_PART = 64 << 20  # bytes of a table that one task encodes, about
_encoders: dict[str, Encoder] = {}


@dataclass(frozen=True)
class Grammar:
    """block_tokens: ids in a block, about; least: places that earn a pair its rule; end: id after each document."""

    block_tokens: int = 1 << 20
    least: int = 16
    end: int = 2


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: The pattern for runs that the fast path knows.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SEP, _LETTER, _DIGIT, _OTHER, _ODD, _WHOLE = range(6)
_BLANKS = b"\t\n\r "
_ODD_PIECE = regex.compile(rb"[^!-~\xc3\x80-\xbf]|'|<\|")


def _kinds() -> tuple[bytes, bytes]:
    """Kind and lower-case form of each byte. The Latin letters after 0xC3 are settled by their place."""
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127] = _OTHER
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    kind[list(_BLANKS)] = _SEP
    kind[0xC3] = _LETTER
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return kind.tobytes(), lower.tobytes()


_KIND, _LOWER = _kinds()


def _knows_runs(tokenizer) -> bool:
    """True for byte-level tokenizers whose normaliser and run pattern are those of the fast path."""
    spec = json.loads(tokenizer.to_str())
    normal, cut, model = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec["model"]
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
    if steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]:
        return False
    parts = cut.get("pretokenizers", [])
    if len(parts) != 2 or parts[0].get("pattern") != {"Regex": _PATTERN} or (parts[0].get("behavior"), parts[0].get("invert")) != ("Removed", True):
        return False
    if parts[1]["type"] != "ByteLevel" or parts[1].get("add_prefix_space") or parts[1].get("use_regex"):
        return False
    special = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
    return special and spec["post_processor"] is None and spec["truncation"] is None and model["type"] == "BPE" and not model["dropout"]


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of runs.

    With a tokenizer of a known form no token spans white space or two runs of letters or punctuation, so a text's ids
    are those of its runs, which the library's model gives. Pieces between white space with other than plain Latin
    text, an apostrophe or a special token's opening go through the library's whole encoder, as do whole texts with a
    tokenizer of any other form.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.fast = _knows_runs(self.tokenizer)
        self.runs: dict[bytes, bytes] = {}

    def _run(self, run: bytes) -> bytes:
        if _ODD_PIECE.search(run):
            ids = self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
        else:
            letters = run.decode() if run.isascii() else "".join(map(_LETTERS.__getitem__, run))
            ids = [t.id for t in self.model.tokenize(letters)]
        return np.array(ids, self.kind).tobytes()

    def encode(self, column: pa.Array):
        """Blocks of texts: their ids end to end, and the number of ids of each text."""
        for row, data, offsets in text_blocks(column, _BLOCK):
            if self.fast:
                yield self._runs(data, offsets)
            else:
                texts = [t or "" for t in column.slice(row, len(offsets) - 1).to_pylist()]
                ids = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                yield np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        kind, low = (np.frombuffer(raw.translate(t), np.uint8).copy() for t in (_KIND, _LOWER))
        latin = np.flatnonzero(data == 0xC3) + 1
        second = data[latin]
        sign = (second == 0x97) | (second == 0xB7)
        kind[latin] = np.where(sign, _ODD, _LETTER)
        low[latin] = np.where((second < 0x9F) & ~sign, second + 32, second)
        outside = kind == _SEP
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = ~outside
        begins[1:] &= outside[:-1] | edge[1:-1]
        odd = (kind == _ODD) | (data == 39)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        where = np.flatnonzero(odd)
        if len(where):
            piece = np.flatnonzero(begins)
            stops = np.flatnonzero(~outside & (np.append(outside[1:], True) | edge[1:]))
            which = np.unique(np.searchsorted(piece, where, "right") - 1)
            depth = np.zeros(len(data) + 1, np.int8)
            depth[piece[which]] = 1
            depth[stops[which] + 1] -= 1
            whole = np.cumsum(depth[:-1], dtype=np.int8).view(bool)
            kind[whole] = _WHOLE
            low[whole] = data[whole]
        begins[1:] |= ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~outside[1:]
        first = np.flatnonzero(begins)
        if not len(first):
            return np.zeros(0, self.kind), np.zeros(len(offsets) - 1, np.int64)
        letters = low.tobytes().translate(None, _BLANKS)
        at = np.append(first - np.cumsum(outside, dtype=np.int32)[first], len(letters)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        names, known = found.dictionary.to_pylist(), self.runs
        got = list(map(known.get, names))
        if None in got:
            if len(known) > _CACHE_RUNS:
                known.clear()
            for k, x in enumerate(got):
                if x is None:
                    got[k] = known[names[k]] = self._run(names[k])
        flat = np.frombuffer(b"".join(got), self.kind)
        size = np.array([len(x) for x in got], np.int64) // flat.itemsize
        code = found.indices.to_numpy()
        n = size[code]
        total = np.concatenate([[0], np.cumsum(n)])
        shift = np.repeat((np.cumsum(size) - size)[code] - total[:-1], n)
        return flat[shift + np.arange(len(shift))], np.diff(total[np.searchsorted(first, offsets)])


def encoder(tokenizer_path: str) -> Encoder:
    found = _encoders.get(tokenizer_path)
    if found is None:
        found = _encoders[tokenizer_path] = Encoder(tokenizer_path)
    return found


def _frequent(pair: np.ndarray, least: int):
    """Pairs at ``least`` places or more: such places (indexes) in order of their pairs, each one's pair, and the pairs with their counts."""
    if pair.dtype == np.uint32 and len(pair) <= 1 << 24:
        slot = (pair * np.uint32(2654435761)) >> np.uint32(12)
        some = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= least)[slot])  # the others are too rare
        order = np.sort((pair[some].astype(np.uint64) << np.uint64(24)) | some.astype(np.uint64))
        key, at = (order >> np.uint64(24)).astype(np.uint32), (order & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        at = np.argsort(pair, kind="stable")
        key = pair[at]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    heavy = count >= least
    return at[np.repeat(heavy, count)], np.repeat(np.arange(heavy.sum()), count[heavy]), key[first[heavy]], count[heavy]


def repair(ids: np.ndarray, ends: np.ndarray, first: int, p: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and the documents' ends among the symbols. ``ends``: places after each document's last id.

    Each round counts the pairs exactly; of a run of one id every second place counts, from the left. Every pair with
    ``least`` places competes: a place goes to its pair unless an overlapping place has a more frequent one. The most
    frequent pair gets all its places, so rounds go on until no pair has ``least`` of them. Symbols are a linked list,
    and from the second round on only places beside a new symbol, and frequent ones that were left over, are counted:
    no other pair can have become frequent.
    """
    n = len(ids)
    x = np.append(ids, 0).astype(np.uint32)  # one more, beside the last
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    alive, closes = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    closes[ends - 1] = True  # no pair begins here
    closes[n] = True
    power = np.zeros(n + 2, np.int32)
    rules: list[np.ndarray] = []
    next_ = first
    places = np.flatnonzero(~closes[:n]).astype(np.int32)
    while len(places):
        small = next_ <= 1 << 16
        a, b = x[places], x[after[places]]
        pair = (a << np.uint32(16)) | b if small else (a.astype(np.uint64) << np.uint64(32)) | b
        at, name, key, count = _frequent(pair, p.least)
        if not len(key):
            break
        heavy = places[at]
        again = np.flatnonzero(a == b)
        if len(again):  # of neighbours in a run of one id every second does not count
            spot = places[again]
            start = np.concatenate([[True], spot[1:] != after[spot[:-1]]])
            nth = np.arange(len(spot))
            nth -= np.maximum.accumulate(np.where(start, nth, 0))
            skip = np.zeros(len(places), bool)
            skip[again[nth % 2 == 1]] = True
            counted = ~skip[at]
            count = np.bincount(name[counted], minlength=len(key))
        else:
            counted = slice(None)
        rank = np.empty(len(key), np.int32)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(key), 0, -1)
        rank[count < p.least] = 0
        spot, pick = heavy[counted], name[counted]
        mine = rank[pick]
        power[spot] = mine
        wins = (mine > power[before[spot]]) & (mine > power[after[spot]])
        power[spot] = 0
        spot, pick = spot[wins], pick[wins]
        good = np.flatnonzero(np.bincount(pick, minlength=len(key)) >= p.least)
        if not len(good):
            break
        symbol = np.zeros(len(key), np.uint32)
        symbol[good] = next_ + np.arange(len(good))
        got = symbol[pick] > 0
        spot, pick = spot[got], pick[got]
        shift = key.dtype.type(16 if small else 32)
        rules.append(np.stack([key[good] >> shift, key[good] & key.dtype.type((1 << int(shift)) - 1)], 1).astype(np.uint32))
        next_ += len(good)
        gone = after[spot]
        x[spot] = symbol[pick]
        closes[spot] = closes[gone]
        alive[gone] = False
        follow = after[gone]
        after[spot], before[follow] = follow, spot
        again = np.zeros(n + 1, bool)
        again[heavy] = again[spot] = True
        again[before[spot]] = True
        places = np.flatnonzero(again & alive & ~closes).astype(np.int32)
    rest = alive[:n]
    return x[:n][rest], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), np.concatenate([[0], np.cumsum(rest)])[ends]


def _segments(rules: np.ndarray, first: int):
    """Stretches of rules that refer to symbols before the stretch only."""
    latest = rules.max(axis=1).astype(np.int64) - first if len(rules) else np.zeros(0, np.int64)
    lo = 0
    while lo < len(rules):
        later = latest[lo:] >= lo
        hi = lo + (int(np.argmax(later)) if later.any() else len(later))
        yield lo, hi
        lo = hi


def pack(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray, first: int, p: Grammar) -> bytes:
    """A block's record; every document has one id at least."""
    symbols, rules, cut = repair(ids, np.cumsum(lens), first, p)
    length = np.ones(first + len(rules), np.uint32)
    for lo, hi in _segments(rules, first):
        length[first + lo : first + hi] = length[rules[lo:hi]].sum(axis=1)
    kind = "<u2" if first + len(rules) <= 1 << 16 else "<u4"
    head = struct.pack("<5I", len(lens), len(rules), len(symbols), first, int(kind[-1]))
    body = b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lens.astype("<u4").tobytes(), np.diff(cut, prepend=0).astype("<u4").tobytes(), rules.astype(kind).tobytes(), length[first:].astype("<u4").tobytes(), symbols.astype(kind).tobytes()])
    return b"RPG2" + zstandard.ZstdCompressor(level=1).compress(body)


class Block:
    """A record read back."""

    def __init__(self, record: bytes):
        if record[:4] != b"RPG2":
            raise ValueError("not a token block")
        body = zstandard.ZstdDecompressor().decompress(record[4:])
        n, rules, symbols, self.first, width = struct.unpack_from("<5I", body)
        at, kind = 20, f"<u{width}"

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("<u1", n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids.tolist(), null.tolist(), strict=True)]
        self.tokens, self.cut = take("<u4", n), np.concatenate([[0], np.cumsum(take("<u4", n), dtype=np.int64)])
        self.rules, self.length, self.symbols = take(kind, 2 * rules).reshape(-1, 2), take("<u4", rules), take(kind, symbols)
        if at != len(body):
            raise ValueError("a token block of the wrong length")
        self._table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def _expansions(self):
        """All expansions end to end; where each symbol's begins, and its length."""
        if self._table is None:
            length = np.ones(self.first + len(self.rules), np.int64)
            length[self.first :] = self.length
            begin = np.cumsum(length) - length
            flat = np.empty(int(length.sum()), np.uint32)
            flat[: self.first] = np.arange(self.first)
            for lo, hi in _segments(self.rules, self.first):
                part = self.rules[lo:hi].ravel()
                n = length[part]
                to = begin[self.first + lo]
                shift = np.repeat(begin[part] - (np.cumsum(n) - n), n)
                flat[to : to + len(shift)] = flat[shift + np.arange(len(shift))]
            self._table = flat, begin, length
        return self._table

    def decode(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids of the documents lo to hi - 1, without decoding the others."""
        flat, begin, length = self._expansions()
        s = self.symbols[self.cut[lo] : self.cut[len(self.tokens) if hi is None else hi]]
        n = length[s]
        shift = np.repeat(begin[s] - (np.cumsum(n) - n), n)
        return flat[shift + np.arange(len(shift))]


def _write(path: str, p: Grammar):
    def run(batches):
        pid, start, block = TaskContext.get().partitionId(), 0, 0
        codec = encoder(path)
        ids: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        docs: list[int | None] = []
        size = 0

        def flush():
            nonlocal start, block, ids, lens, docs, size
            record = pack(docs, np.concatenate(lens), np.concatenate(ids), codec.vocabulary, p)
            out = pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([record], pa.binary())], ["part", "block", "start", "n_tokens", "record"])
            start, block, ids, lens, docs, size = start + size, block + 1, [], [], [], 0
            return out

        for batch in batches:
            names, row = batch.column(0).to_pylist(), 0
            for found, n in codec.encode(batch.column(1)):
                after = np.cumsum(n + 1)  # with the end id
                whole = np.full(int(after[-1]), p.end, codec.kind)
                inner = np.ones(len(whole), bool)
                inner[after - 1] = False
                whole[inner] = found
                lo, before = 0, 0
                while lo < len(n):  # a block ends with the document that fills it
                    hi = min(len(n), int(np.searchsorted(after, before + p.block_tokens - size)) + 1)
                    ids.append(whole[before : after[hi - 1]])
                    lens.append(n[lo:hi] + 1)
                    docs += names[row + lo : row + hi]
                    size += len(ids[-1])
                    lo, before = hi, int(after[hi - 1])
                    if size >= p.block_tokens:
                        yield flush()
                row += len(n)
        if docs:
            yield flush()

    return run


def _read(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch.column("record")[i].as_buffer().to_pybytes())
            ids = block.decode().astype("<u4")
            n = block.tokens.astype(np.int64)
            at = np.cumsum(n) - n
            if n.sum() != len(ids):
                raise ValueError("a token block decodes to another length")
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            before = batch.column("before")[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(at + before), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _bytes(df: DataFrame) -> int:
    """Size of a table as the optimizer estimates it; 0 where it has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def write_tokens(docs: DataFrame, tokenizer_path: str, params: Grammar = Grammar(), scratch: Scratch | None = None) -> DataFrame:
    """The written dataset: part, block, start (within the part), n_tokens, record. Parts and blocks follow doc_id order.

    Parts are ranges of (doc_id, hash of the text, number of the row), so rows that share an id, or have none, are dealt
    over as many parts as their share of the table asks for. There are more parts the larger the table is.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(texts) // _PART))
    ranged = texts.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = ranged.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return scratch.keep(ordered.mapInArrow(_write(tokenizer_path, params), "part int, block int, start long, n_tokens long, record binary"), "blocks", "none")


def read_tokens(written: DataFrame) -> DataFrame:
    """Per document, from the records: doc_id, start, n_tokens, ids_crc32. One total for each part is added up."""
    from pyspark.sql import Window

    totals = written.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    offsets = totals.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    placed = written.join(offsets, F.col("part") == F.col("p")).select((F.col("start") + F.col("offset")).alias("before"), "record")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode(docs: DataFrame, tokenizer_path: str, params: Grammar = Grammar(), scratch: Scratch | None = None) -> DataFrame:
    """Write and read back: one row per row of ``docs`` (doc_id, text) with doc_id, start, n_tokens, ids_crc32.

    A null text is empty: it has the end id alone. Whole texts are encoded, however long; one document is in one block.
    Null doc_ids come first; rows with equal doc_ids are ordered by a hash of the text, equal rows stay apart. Other
    columns are ignored, whatever their names. An empty table gives an empty dataset and result.
    """
    return read_tokens(write_tokens(docs, tokenizer_path, params, scratch))
