"""Language-model scoring with Elias-Fano n-gram tries.

Model.  Bigrams with Dirichlet smoothing over a smoothed unigram:
P(w | u) = (c(u, w) + M p(w)) / (c(u) + M) with p(w) = (c(w) + 1) / (N + V + 1),
where counts are of training tokens (words and one end for each text; the word
before the first is the end).  It is a proper distribution over the V known
tokens and one unknown.

Trie.  A level is a monotone sequence in Elias-Fano code: vocabulary ranks of
the contexts' successors, made monotone by adding the last value of the range
before, beside a pointer sequence that says where each context's range begins.
A bigram is found by a successor search relative to its context's base.  The
smoothed probabilities of nodes are quantised to 16 bits between the least and
largest logarithm of the shard.  A shard's levels live in one file that is
mapped into memory, in the task's temporary folder, for as long as the task
queries it.

Scale.  Nothing of the size of the corpus or its vocabulary is in one place.
Texts are coded in blocks of about BLOCK_TOKENS tokens with a local vocabulary.
Blocks ask the shards of the vocabulary (by hash of the word) for counts, and
then the shards of the trie (by hash of the context, of context and word for frequent contexts) for
probabilities: each message is one row for a (block, shard), with one entry for
each distinct bigram of the block.  A shard gathers the counts of all its blocks,
builds its trie, answers with the bigrams' levels and ends; the blocks sum them
over their documents.  Contexts of over HOT_TOKENS tokens, a fixed part of a
shard, are spread over shards by the word too, so what a shard gets does not
grow with the corpus, but for the entries of a single bigram, one for each
block that has it.  The number of shards, and of the tasks that take one
each, grows with the number of tokens.

Defined results: a null or empty text is one end token; repeated rows are
scored each; a null doc_id counts as 0; without training texts N and V are 0.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, chunked, column, crc_mod, give_back, ids_of, keep, mix64

FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS = 1_800_000
SHARD_TOKENS = 1_600_000
HOT_TOKENS = SHARD_TOKENS // 32
MASS = 1000.0  # M
QUERIES_AT_ONCE = 1 << 16
UNSEEN = 65535  # the level of a bigram that is not in the trie
MOST_TASKS = 50_000  # beyond, a task takes several shards or blocks, one after the other
END = U64(0x1234567890ABCDEF)


# ---- Elias-Fano -----------------------------------------------------------

class EliasFano:
    """A monotone sequence of non-negative integers: low bits packed as they
    are, high bits in unary; select over the unary bits by samples of each 64-bit word."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.n, self.low_bits = n, max(0, int(top // max(1, n)).bit_length() - 1)
        l = self.low_bits
        bits = np.zeros(n + (top >> l) + 2, dtype=bool)
        bits[(values >> l) + np.arange(n)] = True
        pad = -len(bits) % 64
        self.high = np.packbits(np.concatenate([bits, np.zeros(pad, bool)]), bitorder="little")
        low = values & ((1 << l) - 1)
        spread = ((low[:, None] >> np.arange(l)) & 1).astype(bool).reshape(-1) if l else np.zeros(0, bool)
        self.low = np.concatenate([np.packbits(spread, bitorder="little"), np.zeros(8, np.uint8)])
        self._index()

    def _index(self) -> None:
        words = self.high.view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        self.zeros = (np.arange(len(words) + 1) * 64 - self.ones).astype(np.uint32)

    def parts(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "low": self.low, "ones": self.ones, "zeros": self.zeros}

    def _select(self, k: np.ndarray, sample: np.ndarray, flip: bool) -> np.ndarray:
        """Position of the k-th one (or zero)."""
        word = np.searchsorted(sample, k.astype(np.uint32), side="right") - 1
        bits = self.high.view(np.uint64)[word]
        bits = ~bits if flip else bits.copy()
        left = (k - sample[word]).astype(np.int64)
        pos = word.astype(np.int64) * 64
        for width in (32, 16, 8, 4, 2, 1):  # halve the word that holds the bit
            low = bits & U64((1 << width) - 1)
            count = np.bitwise_count(low).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            pos = np.where(up, pos + width, pos)
            bits = np.where(up, bits >> U64(width), low)
        return pos

    def access(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        high = self._select(i, self.ones, False) - i
        if not l:
            return high
        at = i * l
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        window = np.zeros(len(i), np.uint64)
        for b in range(8):
            window |= self.low[np.minimum(byte + b, len(self.low) - 1)].astype(np.uint64) << U64(8 * b)
        return (high << l) | ((window >> shift) & U64((1 << l) - 1)).astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value >= x (n if none): the bucket of x's high bits, then a search in it."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        h = x >> self.low_bits
        last = len(self.high) * 8 - self.n
        def ones_before_zero(k: np.ndarray) -> np.ndarray:
            inside = np.minimum(k, last - 1)
            return np.where(k < last, self._select(inside, self.zeros, True) - inside, self.n)
        lo = np.where(h > 0, ones_before_zero(np.maximum(h - 1, 0)), 0)
        hi = ones_before_zero(h)
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = self.access(np.minimum(mid, self.n - 1)) < x
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo


class Trie:
    """Bigrams of a shard: sorted word hashes, pointers, successors, quantised log10 probabilities."""

    def __init__(self, words: np.ndarray, context: np.ndarray, word: np.ndarray, logp: np.ndarray):
        """context, word: ranks in the sorted ``words``, sorted and distinct."""
        counts = np.bincount(context, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
        self.words = words
        self.pointers = EliasFano(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))
        base = self._bases(context, word)
        self.successors = EliasFano(base + word + 1)
        self.least = float(logp.min()) if len(logp) else 0.0
        self.step = (float(logp.max()) - self.least) / (UNSEEN - 1) if len(logp) else 0.0
        self.levels = np.round((logp - self.least) / self.step).astype(np.uint16) if self.step else np.zeros(len(logp), np.uint16)

    @staticmethod
    def _bases(context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """For each node the last value of the ranges before its context's."""
        if not len(context):
            return np.zeros(0, np.int64)
        begins = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        ends = np.r_[begins[1:], len(context)] - 1
        base = np.concatenate([[0], np.cumsum(word[ends] + 1)[:-1]])
        return np.repeat(base, np.diff(np.r_[begins, len(context)]))

    def mapped(self, folder: str) -> mmap.mmap:
        """Moves all levels to one file and maps it."""
        arrays = {"w": self.words, "q": self.levels, **{f"p{k}": v for k, v in self.pointers.parts().items()}, **{f"s{k}": v for k, v in self.successors.parts().items()}}
        path = os.path.join(folder, "trie")
        place, at = {}, 0
        with open(path, "wb") as f:
            for k, v in arrays.items():
                f.write(b"\0" * (-at % 64))
                at += -at % 64
                place[k] = (at, v.dtype, len(v))
                f.write(np.ascontiguousarray(v).tobytes())
                at += v.nbytes
            f.write(b"\0" * 64)
        with open(path, "rb") as f:
            view = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        get = lambda k: np.frombuffer(view, place[k][1], place[k][2], place[k][0])
        self.words, self.levels = get("w"), get("q")
        for ef, c in ((self.pointers, "p"), (self.successors, "s")):
            for k in ef.parts():
                setattr(ef, k, get(c + k))
        return view

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, level of the log10 probability) of bigrams by the ranks of their words (-1: not of the shard)."""
        n = self.successors.n
        known = (context >= 0) & (word >= 0)
        if not n:
            return np.zeros(len(context), dtype=bool), np.zeros(len(context), np.uint16)
        c = np.maximum(context, 0)
        lo, hi = self.pointers.access(c), self.pointers.access(c + 1)
        known &= lo < hi
        base = np.where(lo > 0, self.successors.access(np.maximum(lo - 1, 0)), 0)
        want = base + np.maximum(word, 0) + 1
        at = np.minimum(self.successors.successor(want), n - 1)
        known &= (at >= lo) & (at < hi) & (self.successors.access(at) == want)
        return known, self.levels[at]


# ---- blocks ---------------------------------------------------------------

_BLOCK = "block long, tokens long, doc_ids binary, held binary, first binary, codes binary, vocabulary binary, counts binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: token codes in a local sorted vocabulary."""
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    held: list = []

    def flush() -> pa.RecordBatch:
        nonlocal serial
        ids, fold, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        vocabulary, codes = np.unique(hashes, return_inverse=True)
        learn = np.repeat(~fold, sizes)
        counts = np.bincount(codes[learn], minlength=len(vocabulary))
        row = [[(task << 32) + serial], [len(codes)]] + [[_pack(x)] for x in (ids, fold, np.concatenate([[0], np.cumsum(sizes)]), codes.astype(np.uint32), vocabulary, counts.astype(np.int64))]
        serial += 1
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), *(pa.array(r, pa.binary()) for r in row[2:])], names=[c.split()[0] for c in _BLOCK.split(", ")])

    tokens = 0
    for part in chunked(batches):
        w = Words(column(part, "text"), lower=True)
        hashes = np.insert(w.hash, w.first[1:], END)
        held.append((ids_of(part), column(part, "held").to_numpy(zero_copy_only=False).astype(bool), np.diff(w.first) + 1, hashes))
        tokens += len(hashes)
        if tokens >= BLOCK_TOKENS:
            yield flush()
            give_back()
            tokens = 0
    if held:
        yield flush()


def _one_table(f):
    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    return run


def _two_tables(f):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return run


def _pack(x: np.ndarray) -> bytes:
    """Compressed byte planes of an array; sorted hashes as their gaps."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=U64(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if kind is np.uint64 else x


def _short(hashes: np.ndarray) -> np.ndarray:
    """The high 48 bits of sorted hashes: enough to tell the words of one shard apart."""
    return hashes >> U64(16)


def _one(batch: pa.Table, i: int, **kinds) -> list[np.ndarray]:
    return [_unpack(batch.column(k)[i].as_py(), t) for k, t in kinds.items()]


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(hashes ^ U64(0x5851F42D4C957F2D)) % U64(shards)).astype(np.int64)


def _ask_counts(shards: int):
    """(block, shard) rows of the block's words and their counts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary, counts = _one(batch, i, vocabulary=np.uint64, counts=np.int64)
                of = _shard(vocabulary, shards)
                for s in np.unique(of).tolist():
                    mine = of == s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s], pa.int32()), column(batch, "block").slice(i, 1), pa.array([_pack(vocabulary[mine])], pa.binary()), pa.array([_pack(counts[mine].astype(np.uint32))], pa.binary())],
                        names=["shard", "block", "words", "counts"],
                    )

    return run


def _give_counts(table: pa.Table) -> pa.Table:
    """All messages of a vocabulary shard: the words' totals, back to each block.
    The row of block -1 has the shard's number of tokens and of known words."""
    asked = [_one(table, i, words=np.uint64, counts=np.uint32) for i in range(table.num_rows)]
    words, at = np.unique(np.concatenate([a for a, _ in asked]), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for _, c in asked])).astype(np.int64)
    ends = np.cumsum([len(a) for a, _ in asked])[:-1]
    replies = [_pack(total[x]) for x in np.split(at, ends)]
    blocks = [*table.column("block").to_pylist(), -1]
    n, shard = table.num_rows, table.column("shard")[0].as_py()
    return pa.table(
        {"block": pa.array(blocks, pa.int64()), "shard": pa.array([shard] * (n + 1), pa.int32()), "totals": pa.array([*replies, None], pa.binary()), "tokens": pa.array([0] * n + [int(total.sum())], pa.int64()), "known": pa.array([0] * n + [int((total > 0).sum())], pa.int64())}
    )


def _gather(parts: pa.Table, vocabulary: np.ndarray, shards: int) -> np.ndarray:
    """A block's totals from its shards' replies."""
    of, out = _shard(vocabulary, shards), np.zeros(len(vocabulary), np.int64)
    for i in range(parts.num_rows):
        out[of == parts.column("shard")[i].as_py()] = _unpack(parts.column("totals")[i].as_py(), np.int64)
    return out


class _Pairs:
    """A block with its words' totals, and its distinct bigrams in the order of the
    trie's shards: the same for the questions and for their answers."""

    def __init__(self, block: pa.Table, i: int, parts: pa.Table, shards: int, hot: int):
        self.ids, self.fold, self.first, self.codes, self.vocabulary = _one(block, i, doc_ids=np.int64, held=bool, first=np.int64, codes=np.uint32, vocabulary=np.uint64)
        self.number = block.column("block")[i].as_py()
        self.total = _gather(parts, self.vocabulary, shards)
        before = np.empty(len(self.codes), np.int64)
        before[1:] = self.codes[:-1]
        before[self.first[:-1]] = np.searchsorted(self.vocabulary, END)
        pair, at = np.unique((before << 32) | self.codes.astype(np.int64), return_inverse=True)
        del before
        u, w = pair >> 32, pair & 0xFFFFFFFF
        of = self.vocabulary[u]
        of = np.where(self.total[u] > hot, mix64(of + self.vocabulary[w] * U64(3)), of)
        shard = _shard(of, shards)
        by = np.argsort(shard, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.at = place[at]  # of each token, its bigram
        self.u, self.w = u[by], w[by]
        self.cuts = np.searchsorted(shard[by], np.arange(shards + 1))


def _ask_bigrams(shards: int):
    """Cogroup of a block and its totals: messages to the trie's shards, an entry
    for each distinct bigram of the block with its occurrences in training texts."""

    @_two_tables
    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        rows = []
        for i in range(block.num_rows):
            b = _Pairs(block, i, parts, shards, HOT_TOKENS)
            learn = np.repeat(~b.fold, np.diff(b.first))
            trained = np.bincount(b.at[learn], minlength=len(b.u)).astype(np.uint32)
            for s in np.flatnonzero(np.diff(b.cuts)).tolist():
                p = slice(b.cuts[s], b.cuts[s + 1])
                words, local = np.unique(np.concatenate([b.u[p], b.w[p]]), return_inverse=True)
                local, n = local.astype(np.uint32), b.cuts[s + 1] - b.cuts[s]
                rows.append((s, b.number, *map(_pack, (_short(b.vocabulary[words]), b.total[words], np.diff(local[:n], prepend=np.uint32(0)), local[n:], trained[p]))))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.table({"shard": pa.array(cols[0], pa.int32()), "block": pa.array(cols[1], pa.int64()), **{f"m{i}": pa.array(c, pa.binary()) for i, c in enumerate(cols[2:])}})

    return run


_MESSAGE = "shard int, block long, " + ", ".join(f"m{i} binary" for i in range(5))
_ANSWER = "block long, shard int, levels binary, least double, step double"


def _answer_shard(tokens: int, known: int):
    """All messages of a trie shard: count, build, map, answer with each bigram's level."""

    @_one_table
    def run(table: pa.Table) -> pa.Table:
        kinds = {"m0": np.uint64, "m1": np.int64, "m2": np.uint32, "m3": np.uint32, "m4": np.uint32}
        asked = [_one(table, i, **kinds) for i in range(table.num_rows)]
        words, first = np.unique(np.concatenate([a[0] for a in asked]), return_index=True)
        total = np.concatenate([a[1] for a in asked])[first]
        keys = []
        for a in asked:
            rank = np.searchsorted(words, a[0])
            keys.append((rank[np.cumsum(a[2], dtype=np.uint32)] << 32) | rank[a[3]])
            a[:4] = [None] * 4
        ends = np.cumsum([len(k) for k in keys])[:-1]
        pair, at = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        at = at.astype(np.uint32)
        count = np.bincount(at, np.concatenate([a[4] for a in asked]))
        del asked
        unigram = (total + 1) / (tokens + known + 1)
        seen = count > 0
        context, word = pair[seen] >> 32, pair[seen] & 0xFFFFFFFF
        trie = Trie(words, context, word, np.log10((count[seen] + MASS * unigram[word]) / (total[context] + MASS)))
        del context, word, seen, count
        least, step = trie.least, trie.step
        levels = np.empty(len(pair), np.uint16)
        with tempfile.TemporaryDirectory() as folder:
            view = trie.mapped(folder)
            for a in range(0, len(pair), QUERIES_AT_ONCE):
                part = pair[a : a + QUERIES_AT_ONCE]
                found, level = trie.query(part >> 32, part & 0xFFFFFFFF)
                levels[a : a + QUERIES_AT_ONCE] = np.where(found, level, UNSEEN)
            del trie
            del view
        n = table.num_rows
        return pa.table(
            {"block": table.column("block"), "shard": table.column("shard"), "levels": pa.array([_pack(levels[x]) for x in np.split(at, ends)], pa.binary()), "least": pa.array([least] * n), "step": pa.array([step] * n)}
        )

    return run


def _finish(shards: int, tokens: int, known: int):
    """Cogroup of a block, its totals and its bigrams' levels: the documents' scores."""

    @_two_tables
    def run(block: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        answers = parts.filter(pc.is_valid(parts.column("levels")))
        parts = parts.filter(pc.is_valid(parts.column("totals")))
        for i in range(block.num_rows):
            b = _Pairs(block, i, parts, shards, HOT_TOKENS)
            unigram = (b.total + 1) / (tokens + known + 1)
            value = np.log10(MASS * unigram[b.w] / (b.total[b.u] + MASS))
            for j in range(answers.num_rows):
                s, least, step = (answers.column(c)[j].as_py() for c in ("shard", "least", "step"))
                (levels,) = _one(answers, j, levels=np.uint16)
                mine = value[b.cuts[s] : b.cuts[s + 1]]
                mine[:] = np.where(levels == UNSEEN, mine, least + levels * step)
            def sums(each: np.ndarray) -> np.ndarray:
                return np.add.reduceat(each, b.first[:-1])  # noqa: B023 (every text has its end)
            out.append(
                pa.table({"doc_id": b.ids, "held_out": b.fold, "n_tokens": np.diff(b.first), "n_known": sums((b.total[b.codes] > 0).astype(np.int64)), "train_tokens": np.full(len(b.ids), tokens), "base_score": sums(np.log10(unigram)[b.codes]), "score": sums(value[b.at])})
            )
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], t) for c, t in zip(_RESULT.split(", "), _TYPES, strict=True)})

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _by_shard(messages: DataFrame, shards: int) -> DataFrame:
    """A task for each shard."""
    return messages.repartitionById(shards, F.col("shard")) if shards <= MOST_TASKS else messages.repartition(MOST_TASKS, "shard")


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    body = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(crc_mod(FOLDS) == HELD_OUT, F.lit(False)).alias("held"))
    blocks = keep(body.mapInArrow(_blocks, _BLOCK))
    size, n_blocks = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if not size:
        return docs.sparkSession.createDataFrame([], _RESULT)
    shards = max(8, -(-size // SHARD_TOKENS))
    by_block = min(max(8, n_blocks), MOST_TASKS)
    asked = blocks.select("block", "vocabulary", "counts").mapInArrow(_ask_counts(shards), "shard int, block long, words binary, counts binary")
    given = keep(_by_shard(asked, shards).groupBy("shard").applyInArrow(_give_counts, "block long, shard int, totals binary, tokens long, known long"))
    row = given.where("block = -1").agg(F.sum("tokens"), F.sum("known")).first()
    tokens, known = int(row[0] or 0), int(row[1] or 0)
    replies = given.where("block >= 0").select("block", "shard", "totals").repartition(by_block, "block")
    bodies = blocks.drop("counts", "tokens").repartition(by_block, "block").groupBy("block")
    messages = bodies.cogroup(replies.groupBy("block")).applyInArrow(_ask_bigrams(shards), _MESSAGE)
    levels = _by_shard(messages, shards).groupBy("shard").applyInArrow(_answer_shard(tokens, known), _ANSWER)
    answers = given.where("block >= 0").select("block", "shard", "totals").unionByName(levels, allowMissingColumns=True)
    return bodies.cogroup(answers.repartition(by_block, "block").groupBy("block")).applyInArrow(_finish(shards, tokens, known), _RESULT)
