"""Sequence packing by lexical retrieval.

Documents are tokenised once, where they are read; document frequencies by token id and the mean length are counted over
all of them. They are then ordered by a lexical key, a weighted MinHash of their token ids: two documents get the same
key with about the probability of the Jaccard similarity of their id sets, weighted by squared idf and saturated count. Stretches of bounded size
of that order are shards, each with a BM25 inverted index over token ids. A seed document opens a window; the index returns its unused neighbours, best first,
which fill the window. The document that overflows is cut, its rest opens the next window, and it is the next seed. So
every sequence but a shard's last is full; the last is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm import _text as tx
from skeinwork.llm._store import Store

#: Bytes of token ids of a shard, and of a partition that is cut into shards.
SHARD_BYTES, PARTITION_BYTES = 3_000_000, 48_000_000
#: Pieces of text that a worker remembers, also from one task to the next, with slots by hash and bytes of the longest (some 50 MB).
KNOWN, SLOTS, LONGEST = 700_000, 1 << 21, 64
#: Bytes that a document counts in a shard beside its ids.
DOC_BYTES = 200
K1, B = 1.2, 0.75
END = 1


#: The pattern of the tokenizers that have the fast path below.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    """Characters below U+0180 whose category begins with ``kind``, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: What normaliser and pattern may treat in other ways than ``_PIECES``: left to the tokenizer, word by word.
_ODD = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")
#: The pieces that PATTERN makes of lower-cased text without ``_ODD``.
_PIECES = re.compile(f"[{_class('L')}]+|[{_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_class('L')}{_class('N')}]+")
_WHITE, _WHITE_BYTES = re.compile("[\t-\r ]+"), re.compile(rb"[\t-\r ]+")


#: Classes of bytes for the fast path: white space, letters, digits, others.
_WHITE_BYTE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[tx.SPACE] = _WHITE_BYTE
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_LATIN = 0xC3  # first byte of U+00C0 to U+00FF


def _plain(text: bytes) -> bool:
    """Only ASCII and the letters of U+00C0 to U+00FF, and no added token: bytes tell where pieces begin."""
    if b"<|" in text:
        return False
    if text.isascii():
        return True
    data = np.frombuffer(text, dtype=np.uint8)
    high = np.flatnonzero(data > 127)
    return len(high) % 2 == 0 and bool((data[high[::2]] == _LATIN).all()) and not np.isin(data[high[1::2]], (0x97, 0xB7, _LATIN)).any()


def _bounds(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of the pieces that PATTERN finds in lower-cased plain texts."""
    kind = _CLASS[low]
    new = np.ones(len(low) + 3, dtype=bool)
    new[1 : len(low)] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    after = np.append(low, np.zeros(3, dtype=np.uint8))
    # An apostrophe that begins a piece and stands right before a letter may begin a contraction.
    at = np.flatnonzero((low == 0x27) & new[: len(low)])
    at = at[_CLASS[after[at + 1]] == _LETTER]
    one, two = after[at + 1], after[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
    long = ~short & (np.isin(one, np.frombuffer(b"rv", dtype=np.uint8)) & (two == 101) | (one == 108) & (two == 108))
    new[at[short | long] + 1] = False
    new[at[short] + 2] = True
    new[at[long] + 3] = True
    first = np.flatnonzero(new[: len(low)])
    end = np.append(first[1:], len(low))
    real = kind[first] != _WHITE_BYTE
    return first[real], end[real]


def _cut(text: bytes) -> list[bytes]:
    """A long plain text in parts of about CHUNK_BYTES that end at white space, which no piece spans."""
    out, at = [], 0
    while len(text) - at > 2 * tx.CHUNK_BYTES and (m := _WHITE_BYTES.search(text, at + tx.CHUNK_BYTES)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in groups of about CHUNK_BYTES."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= tx.CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


class Encoder:
    """Ids of texts, as little-endian 32-bit integers; equal to the tokenizer's own on the whole text.

    A tokenizer that lower-cases, splits by PATTERN and marks the ends of pieces never joins text across pieces, so a
    text's ids are those of its pieces; each is encoded once while it is remembered. Pieces of plain texts are found and
    looked up by a 64-bit hash for a whole chunk of texts at once; pieces of other texts are found by ``_PIECES``. Other
    tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            about = json.load(f)
        end = about["model"].get("end_of_word_suffix")
        steps = [x["type"] for x in (about["normalizer"] or {}).get("normalizers", [])]
        self.split = bool(end) and steps == ["NFC", "Replace", "Lowercase"] and PATTERN in json.dumps(about["pre_tokenizer"]).replace("\\\\", "\\")
        if self.split:
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            vocabulary = self.bare.get_vocab(with_added_tokens=True)
            self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(end)]] = True
            self._forget()

    def _forget(self) -> None:
        """The table of known pieces: hash by slot, number by slot, and where each number's ids stand."""
        self.slot_hash, self.slot_number = np.zeros(SLOTS, dtype=np.uint64), np.zeros(SLOTS, dtype=np.int32)
        self.begin, self.count, self.ids = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 18, dtype=np.uint32)
        self.numbers = self.filled = 0

    @property
    def tokenizer(self):
        """The tokenizer as it is, read when it is first needed."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _pieces(self, text: str) -> list[str]:
        out = []
        for w in _WHITE.split(text):
            out += [w] if _ODD.search(w) else _PIECES.findall(w.lower())
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-cased pieces one after the other, and how many each has."""
        groups = [pieces[i : i + 100] for i in range(0, len(pieces), 100)]
        ids = np.concatenate([e.ids for at in range(0, len(groups), 100) for e in self.bare.encode_batch_fast(groups[at : at + 100], is_pretokenized=True, add_special_tokens=False)]).astype(np.uint32)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _add(self, pieces: list[str]) -> np.ndarray:
        """New pieces' numbers."""
        ids, count = self._encoded(pieces)
        for name, more, have in (("ids", ids, self.filled), ("count", count, self.numbers), ("begin", self.filled + np.cumsum(count) - count, self.numbers)):
            table = getattr(self, name)
            if have + len(more) > len(table):
                table = np.append(table, np.zeros(max(len(table), len(more)), dtype=table.dtype))
                setattr(self, name, table)
            table[have : have + len(more)] = more
        first = self.numbers
        self.numbers, self.filled = first + len(count), self.filled + len(ids)
        return np.arange(first, self.numbers)

    def _plain_ids(self, texts: list[bytes]) -> list[bytes]:
        if self.numbers > KNOWN:
            self._forget()
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        low = tx.LOWER[data]
        latin = np.flatnonzero(data[:-1] == _LATIN) + 1
        latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E)]
        low[latin] += 0x20
        first, end = _bounds(low)
        hashes = tx.span_hashes(low, first, end)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        number = self.slot_number[slot].astype(np.int64)
        # Of a million short pieces, two share a hash with a chance of 1e-7; long ones, which could be made to, have no slot.
        far = end - first > LONGEST
        miss = np.flatnonzero((self.slot_hash[slot] != hashes) | far)
        if len(miss):
            near = miss[~far[miss]]
            _, one, back = np.unique(hashes[near], return_index=True, return_inverse=True)
            raw = low.tobytes()
            new = [raw[first[i] : end[i]].decode() for i in near[one]] + [raw[first[i] : end[i]].decode() for i in miss[far[miss]]]
            made = self._add(new)
            number[near] = made[: len(one)][back]
            number[miss[far[miss]]] = made[len(one) :]
            at = slot[near[one]]  # of new pieces that share a slot, the last one has it
            self.slot_hash[at], self.slot_number[at] = hashes[near[one]], made[: len(one)]
        count = self.count[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.begin[number] - total[:-1], count)].astype("<u4")
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        cuts = total[np.searchsorted(first, starts)]
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _other_ids(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        every = list(set().union(*pieces))
        odd = [w for w in every if _ODD.search(w)]
        known = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else [], strict=True)}
        if plain := [w for w in every if w not in known]:
            ids, count = self._encoded(plain)
            ends, data = (4 * np.cumsum(count)).tolist(), ids.astype("<u4").tobytes()
            known.update(zip(plain, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        return [b"".join(map(known.__getitem__, x)) for x in pieces]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.split:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        plain = [_plain(t) for t in texts]
        parts = [_cut(t) for t, p in zip(texts, plain, strict=True) if p]
        flat, done = [x for p in parts for x in p], []
        for group in _grouped(flat):
            done += self._plain_ids(group)
        ids = iter(done)
        own = iter([b"".join(next(ids) for _ in p) for p in parts])
        other = iter(self._other_ids([t.decode() for t, p in zip(texts, plain, strict=True) if not p]) if not all(plain) else ())
        return [next(own if p else other) for p in plain]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for the tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Index:
    """BM25 over the token ids of a shard's documents, with the corpus's idf by token id and mean length."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        of = np.repeat(np.arange(n), sizes)
        key, tf = np.unique((of.astype(np.int64) << 32) | np.concatenate(docs).astype(np.int64), return_counts=True)
        del of
        doc, self.term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32)
        del key
        self.begin = np.searchsorted(doc, np.arange(n + 1))
        self.df = np.bincount(self.term)
        order = np.argsort(self.term, kind="stable")
        self.at = np.concatenate([[0], np.cumsum(self.df)])
        self.post_doc, tf = doc[order], tf[order]
        self.post_weight = idf[self.term[order]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.post_doc] / mean))
        self.n = n
        # Terms of over a quarter of the documents are added as whole rows: at most four cells a posting.
        self.rows = {}
        for t in np.flatnonzero(self.df > max(8, n // 4)):
            self.rows[int(t)] = row = np.zeros(n)
            row[self.post_doc[self.at[t] : self.at[t + 1]]] = self.post_weight[self.at[t] : self.at[t + 1]]

    def neighbours(self, seed: int, used: np.ndarray, most: int = 64, common: int | None = None) -> np.ndarray:
        """Unused documents that share a query term with the seed, best first, ties to the smaller number.

        Terms of more than ``common`` documents are not looked up; without it, those of a third, if more than 8.
        """
        terms = self.term[self.begin[seed] : self.begin[seed + 1]]
        # A term of one document is the seed's own.
        terms = terms[(self.df[terms] > 1) & (self.df[terms] <= (max(8, self.n // 3) if common is None else common))].tolist()
        if not terms:
            return np.zeros(0, dtype=np.int64)
        spans = [slice(self.at[t], self.at[t + 1]) for t in terms if t not in self.rows]
        score = np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n) if spans else np.zeros(self.n)
        for t in terms:
            if t in self.rows:
                score += self.rows[t]
        score[used] = 0
        top = np.argpartition(-score, min(most, self.n - 1))[:most]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


def order(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> Iterator[int]:
    """The documents' numbers in the order in which they fill windows."""
    if not docs:
        return
    index, used = Index(docs, idf, mean), np.zeros(len(docs), dtype=bool)
    seed, filled, queue, following = None, 0, iter(()), 0
    for _ in range(len(docs)):
        take = next((int(d) for d in queue if not used[d]), None)
        if take is None and seed is not None:
            queue = iter(index.neighbours(seed, used, common=len(docs)))
            take = next((int(d) for d in queue if not used[d]), None)
        if take is None:
            while used[following]:
                following += 1
            take = following
        used[take] = True
        filled += len(docs[take])
        if seed is None or filled >= window:
            seed, queue, filled = take, iter(()), filled % window
        yield take


def pack(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset). Windows are full; the last is cut into powers of two."""
    total = sum(map(len, docs))
    rest = total % window
    cuts = [window] * (total // window) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    out, sequence, offset = [], 0, 0
    for d in order(docs, window, idf, mean):
        start = 0
        while start < len(docs[d]):
            n = min(len(docs[d]) - start, cuts[sequence] - offset)
            out.append((d, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == cuts[sequence]:
                sequence, offset = sequence + 1, 0
    return out


def _statistics(tokens: DataFrame) -> tuple[np.ndarray, float, int]:
    """Of all documents: idf by token id, mean length, and bytes of ids. No more rows than the vocabulary has ids come here."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, total, size = np.zeros(1 << 16, dtype=np.int64), 0, 0, 0
        for b in batches:
            for x in _ids(b.column("ids"), b.column("wide")):
                x = np.sort(x, kind="stable")  # of two bytes: a radix sort
                x = x[np.append(True, x[1:] != x[:-1])]
                if x[-1] >= len(df):
                    df = np.append(df, np.zeros(int(x[-1]) + 1 - len(df), dtype=np.int64))
                df[x] += 1
            docs += b.num_rows
            size += (data := pa.compute.sum(pa.compute.binary_length(b.column("ids"))).as_py() or 0)
            total += data // 2 if not pa.compute.any(b.column("wide")).as_py() else sum(map(len, _ids(b.column("ids"), b.column("wide"))))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2, -3], term])), pa.array(np.concatenate([[docs, total, size], df[term]]))], names=["term", "n"])

    got = {r["term"]: r["n"] for r in tokens.mapInArrow(emit, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, total, size = (got.pop(k, 0) for k in (-1, -2, -3))
    df = np.zeros(max(got, default=0) + 1)
    df[list(got)] = list(got.values())
    return np.log1p((docs - df + 0.5) / (df + 0.5)), total / max(docs, 1), size


def _ids(column: pa.Array, wide: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u4" if w else "<u2") for x, w in zip(column.to_pylist(), wide.to_pylist(), strict=True)]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and ``ids``.

    A document's ids are the tokenizer's (``tokenizer`` is its file's path on the executors) and then 1; null text is
    empty. Each id lies in one piece. Rows that share an id are documents of their own; a null id stays null. ``ids``
    are the piece's ids. An empty table gives no rows.
    """
    tx.small_batches(docs.sparkSession)
    small = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for part, texts in tx.chunks(batches):
            ids = [np.frombuffer(x, dtype="<u4") for x in own.encode(texts)]
            # Two bytes an id are enough for a vocabulary of up to 65,536.
            wide = any(len(x) and x.max() > 0xFFFF for x in ids)
            data = [np.append(x, END).astype("<u4" if wide else "<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([wide] * len(ids)), pa.array(data, pa.binary())], names=["id", "wide", "ids"])

    tokens = Store(docs.sparkSession).put(small.mapInArrow(tokenise, "id long, wide boolean, ids binary"), "tokens")
    idf, mean, size = _statistics(tokens)
    first = priorities(idf)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = [lexical_key(x, first) for x in _ids(b.column("ids"), b.column("wide"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([x[k] for x in low], pa.int64()) for k in range(2)]], names=["id", "wide", "ids", "k1", "k2"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = TaskContext.get().partitionId() << 32
        for own, docs in _shards(batches, shard_bytes):
            rows = [(own[d], a, n, docs[d][a : a + n].astype("<u4"), len(docs[d]), begun + s, o) for d, a, n, s, o in pack(docs, window, idf, mean)]
            begun = rows[-1][5] + 1
            for at in range(0, len(rows), 1000):
                columns = list(zip(*rows[at : at + 1000], strict=True))
                crc = [zlib.crc32(x.tobytes()) for x in columns[3]]
                cast = [pa.array(c, pa.int64()) for c in (columns[0], columns[1], columns[2], crc, columns[4], columns[5], columns[6])]
                flat = pa.array(np.concatenate(columns[3]).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*cast, lists], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    # A third column splits copies, which share both keys.
    by = ["k1", "k2", F.xxhash64("id", "ids")]
    dealt = tokens.mapInArrow(keyed, "id long, wide boolean, ids binary, k1 long, k2 long").repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids array<int>"
    return dealt.select("id", "wide", "ids").mapInArrow(fill, schema).withColumnRenamed("id", id_col)


def priorities(idf: np.ndarray) -> np.ndarray:
    """A fixed exponential variable of each token id over its weight, idf squared: the smallest of a set is a weighted MinHash."""
    u = (tx.mix(np.arange(len(idf), dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(11)).astype(float) / 2.0**53
    return (-np.log(1 - u) / np.maximum(idf, 1e-9) ** 2).astype(np.float32)


def lexical_key(ids: np.ndarray, first: np.ndarray) -> tuple[int, int]:
    """Hashes of the two ids of smallest priority, divided by BM25's saturated count (its end counts, so there is one id at least).

    The ids' hashes and not their priorities: those are smaller in longer documents, which would gather in one place.
    """
    ids, count = np.unique(ids, return_counts=True)
    low = ids[np.argsort(first[ids] * (1 + K1 / count), kind="stable")[:2]]
    key = tx.mix(low.astype(np.uint64) + np.uint64(77)) >> np.uint64(1)
    return int(key[0]), int(key[-1])


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and token ids of consecutive documents, cut where ``most`` bytes, with DOC_BYTES a document, are reached."""
    own, docs, size = [], [], 0
    for b in batches:
        for i, ids in zip(b.column("id").to_pylist(), _ids(b.column("ids"), b.column("wide")), strict=True):
            own.append(i)
            docs.append(ids)
            size += ids.nbytes + DOC_BYTES
            if size >= most:
                yield own, docs
                own, docs, size = [], [], 0
    if docs:
        yield own, docs
    tx.release()
