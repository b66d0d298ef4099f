"""Token-ID output: static range asymmetric numeral system in independent interleaved blocks.

Texts are encoded with a tokenizer's file, in ascending id order, and written by the executors
to files of at most `FILE_TOKENS` tokens. A file holds one shared frequency table, an index of
its documents, a directory of blocks (place, CRC-32, checkpoints) and the blocks. Each block
is coded by `LANES` interleaved states and can be read alone; from any checkpoint inside it
reading can start too. The manifest of the files of tasks that succeeded is the commit.

Cases: a null or empty text is the end id alone; a null doc_id comes first; rows that share an
id stand next to each other, ordered by a hash of the text, by which a common id is dealt out
too; the string of a special token in a text becomes that token's id, as the tokenizer's file
says, or ordinary text with `plain`; a text of any length is encoded whole and may run over
blocks and beyond `FILE_TOKENS`; extra columns are ignored; an empty table gives no files and an
empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, shuffle_parts, text_bytes, written
from .warc import open_fs

MAGIC = b"RANSTOK1"
BITS = 18
LANES = 2048
BLOCK_STEPS = 256
CHECK_STEPS = 128
FILE_TOKENS = 4 << 20
#: Distinct pieces kept by a worker; beyond, the half learned first (mostly the frequent) stays.
CACHE = 1_200_000
END_ID = 2
LOW = np.uint64(1 << 31)
U32 = np.uint64(32)


_SPACES, _WIDE = np.zeros(256, bool), np.zeros(256, bool)
_SPACES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

# ---- tokens of texts ----


class Encoder:
    """ids of texts; pieces between white space are encoded once and kept.

    The tokenizer's pattern never joins a non-space to a following space, so a text without two
    white-space characters in a row, none at its ends and no string of an added token is the
    sequence of its pieces; any other text is encoded as a whole.
    """

    UNSAFE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]{2}|^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]$"
    TAIL = ".,;:!?%#*$&|"

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        settings = json.loads(self.tok.to_str())
        pattern = settings.get("pre_tokenizer") or {}
        #: strings that are cut out of a text before its pattern is applied: such a text is encoded as a whole
        self.added = [t["content"] for t in settings.get("added_tokens") or [] if t["content"] and not (plain and t["special"])]
        self.by_piece = pattern.get("type") == "ByteLevel" and not pattern.get("add_prefix_space") and pattern.get("use_regex", True) and self.tok.normalizer is None and len(self.line) == 1
        self.by_piece &= not any(c.isspace() for t in self.added for c in t)
        self.kept: dict[str, bytes] = {"": b""}
        self.line_bytes = np.array(self.line, "<u4").tobytes()

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, strings: list[str]) -> None:
        plain = [s for s in strings if s.strip() and s.lstrip(" ").split() == [s.lstrip(" ")]]
        odd = set(strings).difference(plain)
        for s, ids in zip(odd, self.whole(list(odd)), strict=True):
            self.kept[s] = np.array(ids, "<u4").tobytes()
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = np.array(self.whole(["\n".join(some) + "\n"])[0], "<u4")
            stops = np.flatnonzero(ids == self.line[0])
            if len(stops) != len(some):
                raise ValueError("pieces cannot be told apart")
            raw, a = ids.tobytes(), 0
            for s, b in zip(some, (stops * 4).tolist(), strict=True):
                self.kept[s] = raw[a:b]
                a = b + 4

    def _parts(self, piece: str) -> tuple[bool, str, str]:
        """Whether a line break comes first, then the stem with its space, then end marks."""
        brk = piece[:1] == "\n"
        s = piece[1:] if brk else piece and " " + piece
        stem = s.rstrip(self.TAIL)
        return (brk, stem, s[len(stem) :]) if stem and stem[-1].isalpha() else (brk, s, "")

    def _unsafe(self, texts: pa.Array) -> np.ndarray:
        if not self.by_piece:
            return np.ones(len(texts), bool)
        raw, off = text_bytes(texts)
        out = np.zeros(len(texts), bool)
        for t in self.added:
            out |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        if _WIDE[raw].any():  # bytes that white space beyond ASCII begins with
            return out | pc.match_substring_regex(texts, self.UNSAFE).to_numpy(zero_copy_only=False)
        space = _SPACES[raw]
        twice = np.flatnonzero(space[1:] & space[:-1])
        out[np.searchsorted(off, twice, "right") - 1] = True  # too careful across two texts: harmless
        some = np.flatnonzero(np.diff(off))
        out[some] |= space[off[some]] | space[off[some + 1] - 1]
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts without end ids, and how many each text has."""
        unsafe = self._unsafe(texts)
        if unsafe.any():
            if unsafe.all():
                ids = self.whole(texts.to_pylist())
                return np.array([x for y in ids for x in y], "<u4"), np.array([len(x) for x in ids], np.int64)
            some, n_some = self.batch(texts.filter(pa.array(~unsafe)))
            rest, n_rest = self.batch(texts.filter(pa.array(unsafe)))
            n = np.zeros(len(texts), np.int64)
            n[~unsafe], n[unsafe] = n_some, n_rest
            out = np.empty(int(n.sum()), "<u4")
            out[np.repeat(~unsafe, n)], out[np.repeat(unsafe, n)] = some, rest
            return out, n
        lines = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\n", texts.type), texts, pa.scalar("", texts.type)), "\n", " \n")
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        if len(self.kept) > CACHE:
            self.kept = dict(itertools.islice(self.kept.items(), CACHE // 2))
        pieces = [self._parts(p) for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        kept, line = self.kept, self.line_bytes
        new = {s for _, a, b in pieces for s in (a, b) if s not in kept}
        if new:
            self._learn(list(new))
        parts = [line + kept[a] + kept[b] if brk else kept[a] + kept[b] if b else kept[a] for brk, a, b in pieces]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, begin = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[code] - (ends - n), n)]
        off = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        keep = np.ones(len(ids), bool)
        keep[off[:-1]] = False  # the line break put before every text
        return ids[keep], np.diff(off) - 1


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]


# ---- coder ----


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, each at least 1."""
    whole = 1 << bits
    f = np.maximum(1, (counts.astype(np.float64) * whole / max(1, counts.sum())).astype(np.int64))
    while (more := whole - int(f.sum())) != 0 and len(f):
        k = int(f.argmax())
        f[k] += more if more > 0 else -min(-more, max(1, int(f[k]) // 2))
    return f


def encode_block(symbols: np.ndarray, freq: np.ndarray, cum: np.ndarray, bits: int = BITS, lanes: int = LANES, every: int = CHECK_STEPS):
    """Words, and (step, first word, states) at every checkpoint; the first is the start."""
    n = len(symbols)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    out, marks, total = [], [], 0
    shift = np.uint64(63 - bits)
    b = np.uint64(bits)
    for t in range(steps - 1, -1, -1):
        s = symbols[t * lanes : (t + 1) * lanes]
        f, x = freq[s], state[: len(s)]
        full = x >= (f << shift)
        words = x[full].astype(np.uint32)  # the low half
        x = np.where(full, x >> U32, x)
        q = x // f
        state[: len(s)] = (q << b) + (x - q * f) + cum[s]
        out.append(words)
        total += len(words)
        if t % every == 0:
            marks.append((t, total, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return words, [(t, total - w, s) for t, w, s in marks[::-1]]


def decode_block(words: np.ndarray, mark, stop: int, n: int, freq, cum, table, bits: int = BITS, lanes: int = LANES) -> np.ndarray:
    """Symbols of the steps from a checkpoint to step `stop`, of a block of n symbols."""
    t, pos, state = mark[0], mark[1], mark[2].copy()
    out = np.empty(min(n, stop * lanes) - t * lanes, table.dtype)
    at, mask, b = 0, np.uint64((1 << bits) - 1), np.uint64(bits)
    while at < len(out):
        k = min(lanes, len(out) - at)
        x = state[:k]
        slot = x & mask
        s = table[slot]
        out[at : at + k] = s
        x = freq[s] * (x >> b) + slot - cum[s]
        need = np.flatnonzero(x < LOW)
        x[need] = (x[need] << U32) | words[pos : pos + len(need)]
        pos += len(need)
        state[:k] = x
        at += k
    return out


def write_file(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """A whole file: magic, header, table, index, directory, blocks."""
    z = zstandard.ZstdCompressor(level=3)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place_of = np.zeros(len(counts), np.int32)
    place_of[symbols] = np.arange(len(symbols))
    dense = place_of[ids]
    freq = frequencies(counts[symbols])
    f, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
    blocks, directory, states, place = [], [], [], 0
    width = LANES * BLOCK_STEPS
    for a in range(0, len(ids), width):
        words, marks = encode_block(dense[a : a + width], f, cum)
        raw = words.astype("<u4").tobytes()
        directory.append([a, min(width, len(ids) - a), place, len(raw), zlib.crc32(raw), [[t, w] for t, w, _ in marks]])
        states += [s.astype("<u8").tobytes() for _, _, s in marks]
        blocks.append(raw)
        place += len(raw)
    null = [i for i, d in enumerate(doc_ids) if d is None]
    index = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [z.compress(x) for x in (symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes(), index.tobytes(), lengths.astype("<i8").tobytes(), b"".join(states))]
    head = json.dumps({"bits": BITS, "lanes": LANES, "tokens": len(ids), "docs": len(doc_ids), "null_docs": null, "parts": [len(p) for p in parts], "blocks": directory}).encode()
    meta = z.compress(head)
    body = b"".join(parts)
    return MAGIC + struct.pack("<III", len(meta), zlib.crc32(meta), zlib.crc32(body)) + meta + body + b"".join(blocks)


class TokenFile:
    """A file's tables; its blocks can be decoded alone, and from any of their checkpoints."""

    def __init__(self, data: bytes):
        d = zstandard.ZstdDecompressor()
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, c1, c2 = struct.unpack_from("<III", data, 8)
        meta = data[20 : 20 + n]
        at = 20 + n
        if zlib.crc32(meta) != c1:
            raise ValueError("damaged header")
        self.head = json.loads(d.decompress(meta))
        body = data[at : at + sum(self.head["parts"])]
        if zlib.crc32(body) != c2:
            raise ValueError("damaged tables")
        parts, p = [], 0
        for k in self.head["parts"]:
            parts.append(d.decompress(body[p : p + k]))
            p += k
        self.symbols, self.freq = np.frombuffer(parts[0], "<u4"), np.frombuffer(parts[1], "<u4").astype(np.uint64)
        self.docs, self.lengths = np.frombuffer(parts[2], "<i8").tolist(), np.frombuffer(parts[3], "<i8")
        for i in self.head["null_docs"]:
            self.docs[i] = None
        self.states = np.frombuffer(parts[4], "<u8").reshape(-1, self.head["lanes"])
        self.cum = np.cumsum(self.freq, dtype=np.uint64) - self.freq
        self.table = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        self.blocks = self.head["blocks"]
        self.first_state = np.append(0, np.cumsum([len(b[5]) for b in self.blocks])).astype(np.int64)
        self.data, self.base = data, at + len(body)

    def block(self, k: int, mark: int = 0) -> tuple[int, np.ndarray]:
        """Place in the file of the first token at a checkpoint of block k, and the ids from there to the block's end."""
        start, count, place, size, crc, marks = self.blocks[k]
        raw = self.data[self.base + place : self.base + place + size]
        if zlib.crc32(raw) != crc:
            raise ValueError(f"damaged block at token {start}")
        lanes, (t, w) = self.head["lanes"], marks[mark]
        words = np.frombuffer(raw, "<u4").astype(np.uint64)
        got = decode_block(words, (t, w, self.states[self.first_state[k] + mark]), -(-count // lanes), count, self.freq, self.cum, self.table, self.head["bits"], lanes)
        return start + t * lanes, self.symbols[got]


def read_file(data: bytes) -> tuple[np.ndarray, list, np.ndarray]:
    """ids, document ids and lengths of a file; every checksum is verified."""
    f = TokenFile(data)
    out = np.empty(f.head["tokens"], "<u4")
    for k in range(len(f.blocks)):
        start, ids = f.block(k)
        out[start : start + len(ids)] = ids
    return out, f.docs, f.lengths


# ---- jobs ----


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, plain: bool = False) -> DataFrame:
    """Write the files; manifest (file, start, tokens, docs) of the committed ones."""
    n = shuffle_parts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # rows of one id are dealt out by their texts, so a common id (or none) is no single task
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches):
        enc, part = encoder(tokenizer, plain), TaskContext.get().partitionId()
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        held, ids, lens, docs_, before = 0, [], [], [], 0

        def flush():
            name = f"{path}/tokens-{uuid.uuid4().hex}.rans"
            with fs.open_output_stream(open_fs(name)[1], compression=None) as out:
                out.write(write_file(np.concatenate(ids), docs_, np.concatenate(lens)))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((part, pa.int64()), (before, pa.int64()), (name, pa.string()), (held, pa.int64()), (len(docs_), pa.int64()))], ["part", "before", "file", "tokens", "docs"])

        for b in batches:
            texts, docs_in = b.column("text"), b.column("id")
            size = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
            a = 0
            while a < len(texts):
                z = max(a + 1, int(np.searchsorted(size, size[a] + (8 << 20), "right")) - 1)
                got, k = enc.batch(texts.slice(a, z - a))
                stops = np.cumsum(k + 1) - 1
                full = np.empty(len(got) + len(k), "<u4")
                mark = np.zeros(len(full), bool)
                mark[stops] = True
                full[mark], full[~mark] = end_id, got
                ids.append(full)
                lens.append(k + 1)
                docs_ += docs_in.slice(a, z - a).to_pylist()
                held += len(full)
                a = z
                if held >= FILE_TOKENS:
                    yield flush()
                    before, held, ids, lens, docs_ = before + held, 0, [], [], []
        if docs_:
            yield flush()

    files = written(rows.mapInArrow(lean(run), "part long, before long, file string, tokens long, docs long"), "token-manifest")
    # one row for each partition, whose number is a setting
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(base, "part").select("file", (F.col("base") + F.col("before")).alias("start"), "tokens", "docs")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def run(batches):
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, at = open_fs(file)
                with fs.open_input_stream(at, compression=None) as f:
                    ids, docs, lengths = read_file(f.read())
                raw, ends = memoryview(ids.tobytes()), np.cumsum(lengths)
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = shuffle_parts(manifest.sparkSession)
    return manifest.repartition(n, "file").mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_blocks(manifest: DataFrame) -> DataFrame:
    """(start, ids) of every block of the files: each block is a row to deal out, and is decoded by itself."""

    def listed(batches):
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                fs, at = open_fs(file)
                with fs.open_input_stream(at, compression=None) as f:
                    n = len(TokenFile(f.read()).blocks)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(n), pa.int64())], ["file", "base", "block"])

    def decoded(batches):
        for b in batches:
            for file, base, k in zip(*(b.column(c).to_pylist() for c in ("file", "base", "block")), strict=True):
                fs, at = open_fs(file)
                with fs.open_input_stream(at, compression=None) as f:
                    start, ids = TokenFile(f.read()).block(k)
                yield pa.RecordBatch.from_arrays([pa.array([base + start], pa.int64()), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["start", "ids"])

    n = shuffle_parts(manifest.sparkSession)
    blocks = manifest.repartition(n, "file").mapInArrow(lean(listed), "file string, base long, block long")
    return blocks.repartition(n, "file", "block").mapInArrow(lean(decoded), "start long, ids array<long>")


def roundtrip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, plain: bool = False) -> DataFrame:
    """Write docs as token files, read the files back."""
    return read_tokens(write_tokens(docs, fresh_path(docs.sparkSession, "tokens"), tokenizer, end_id, plain))
