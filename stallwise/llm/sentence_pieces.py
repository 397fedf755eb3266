"""SentencePiece encoding and decoding by batched numpy Viterbi.

The lattice of a word has a node after each byte and an edge for each piece that ends there. Words of
equal length advance together: the hashes of all substrings of one length probe the sorted keys of the
pieces of that length, and vectorised maxima store the back pointers.

The score of an edge says whether merges in the order of the model's scores could have left this piece
after the one before it. A BPE model admits exactly one such path through a word, and it is what the
library's merges give; a sum of the scores, as for unigram models, would give other ids here. Two
neighbours fit together if no merge across their boundary would have come before the merges that made
them. That is found by undoing those merges from the latest on, for all pairs of a batch at once.

White space is ``▁`` and opens a word. Runs of bare ``▁`` score alike and last, hence merge from the
left into the longest piece there is. Characters without a piece become byte pieces.

How it scales. Encoding is a map over documents: no shuffle, memory bounded by a chunk of a text and
a cache of words per worker.

Edge cases. Null and empty texts have no ids. Texts without any space are words of any length. A literal
``▁`` decodes to a space, as in the library. Extra columns are ignored, repeated rows stay.
"""
from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import spans as S
from .common import register, table
from .wordcache import WordCache

_NEVER = 1 << 40


class Pieces:
    """The vocabulary of a BPE model with byte fallback, ready for vectorised encoding and decoding."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.n = n
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        text = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.raw = [b"" if special[i] else text[i].replace("▁", " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_id):
            self.raw[i] = bytes([b])
        self.bare = sp.piece_to_id("▁")
        self.runs = {len(t): i for i, t in enumerate(text) if t and not t.strip("▁")}
        normal = [i for i in range(n) if not special[i] and (text[i].strip("▁") or i == self.bare)]
        ids = {text[i]: i for i in normal}
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n, np.int64)
        rank[np.argsort(-score, kind="stable")] = np.arange(n)
        self.rank = np.full(n, -1, np.int64)  # when a piece is made by a merge; -1: it never is
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        joins, usable = {}, []
        for i in normal:
            t = text[i]
            for k in range(1, len(t)):
                a, b = ids.get(t[:k]), ids.get(t[k:])
                if a is not None and b is not None:
                    joins[a, b] = i
        for i in normal:
            own = [ids.get(c, -1) for c in text[i]]
            while len(own) > 1:
                made = [(rank[joins[p]], k) for k, p in enumerate(zip(own, own[1:])) if p in joins]
                if not made:
                    break
                _, k = min(made)
                last = own[k], own[k + 1]
                own[k: k + 2] = [joins[last]]
            if own == [i]:
                usable.append(i)
                if len(text[i]) > 1:
                    self.left[i], self.right[i] = last
                    self.rank[i] = rank[i]
        keys = np.array([a * n + b for a, b in joins], np.int64)
        order = np.argsort(keys)
        self.join_keys = keys[order]
        self.join_rank = np.array([rank[i] for i in joins.values()], np.int64)[order]
        self.table = {}
        by_length: dict[int, list[int]] = {}
        for i in usable:
            by_length.setdefault(len(self.raw[i]), []).append(i)
        for k, found in sorted(by_length.items()):
            data = np.frombuffer(b"".join(self.raw[i] for i in found), np.uint8).reshape(-1, k)
            h = self._prefix(data)[:, k]
            o = np.argsort(h)
            self.table[k] = h[o], np.array(found, np.int32)[o], data[o]
        self.lookup = {self.raw[i]: i for i in usable}
        self.pair = np.zeros((256, 256), bool)
        for i in usable:
            b = np.frombuffer(self.raw[i], np.uint8)
            self.pair[b[:-1], b[1:]] = True
        self.size = np.array([len(x) for x in self.raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self._memo_key = np.full(1 << 20, -1, np.int64)
        self._memo = np.zeros(1 << 20, bool)

    # hashes of all substrings of equal-length words -------------------------------------------------
    @staticmethod
    def _prefix(data):
        up, _ = S._TEXT.upto(data.shape[1])
        out = np.zeros((len(data), data.shape[1] + 1), np.uint64)
        np.cumsum(S._BYTE[data] * up[: data.shape[1]], axis=1, out=out[:, 1:])
        return out

    def _probe(self, data, prefix, i, k):
        """Ids of the pieces of k bytes at byte i, or -1; where the hash is known the bytes are compared."""
        keys, ids, raw = self.table[k]
        h = (prefix[:, i + k] - prefix[:, i]) * S._TEXT.upto(prefix.shape[1])[1][i]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        out = np.full(len(h), -1, np.int32)
        hit = np.flatnonzero(keys[at] == h)
        hit = hit[(data[hit, i: i + k] == raw[at[hit]]).all(axis=1)]
        out[hit] = ids[at[hit]]
        return out

    # which pieces may stand side by side --------------------------------------------------------------
    def _fits(self, a, b):
        """For each pair: no merge across the boundary comes before the merges that made a and b."""
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(x), _NEVER, np.int64)
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            key = p * self.n + q
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            across = np.where(self.join_keys[at] == key, 2 * self.join_rank[at], _NEVER)
            bad = across < limit[live]
            good[live[bad]] = False
            made_p, made_q = 2 * self.rank[p], 2 * self.rank[q] + 1  # of equal merges the left comes first
            undo_q = made_q > made_p
            go = ~bad & (np.maximum(made_p, made_q) >= 0)
            x[live] = np.where(undo_q, p, self.right[p])
            y[live] = np.where(undo_q, self.left[q], q)
            limit[live] = np.maximum(made_p, made_q)
            live = live[go]
        return good

    def fits(self, a, b):
        key = a.astype(np.int64) * self.n + b
        slot = (S.mix(key) >> np.uint64(44)).astype(np.int64)
        miss = self._memo_key[slot] != key
        out = self._memo[slot]
        if miss.any():
            fresh, back = np.unique(key[miss], return_inverse=True)
            good = self._fits(fresh // self.n, fresh % self.n)
            place = (S.mix(fresh) >> np.uint64(44)).astype(np.int64)
            self._memo_key[place] = fresh  # the last of equal slots stays; both columns take the same one
            self._memo[place] = good
            out = out.copy()
            out[miss] = good[back]
        return out

    # encoding -------------------------------------------------------------------------------------------
    def _unknown(self, data, prefix):
        """Bytes of characters that have no piece."""
        n, size = data.shape
        out = np.zeros((n, size), bool)
        length = np.where(data < 0x80, 1, np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, np.where(data >= 0xC0, 2, 0))))
        for i in range(size):
            for k in (1, 2, 3, 4):
                here = (length[:, i] == k) if i + k <= size else None
                if here is not None and here.any():
                    lost = here & ((self._probe(data, prefix, i, k) < 0) if k in self.table else True)
                    out[lost, i: i + k] = True
        return out

    def _viterbi(self, data):
        """Ids and counts of words of equal length, one per row of bytes."""
        n, size = data.shape
        prefix = self._prefix(data)
        unknown = self._unknown(data, prefix)
        last = np.full((n, size + 1), -1, np.int32)
        back = np.zeros((n, size + 1), np.int16)
        for j in range(1, size + 1):
            best = np.zeros(n, np.int16)
            node = np.full(n, -1, np.int32)
            for k in self.table:
                if k > j:
                    break
                i = j - k
                piece = self._probe(data, prefix, i, k)
                rows = np.flatnonzero((piece >= 0) & ((last[:, i] >= 0) if i else True))
                if i and len(rows):
                    rows = rows[self.fits(last[rows, i], piece[rows])]
                better = rows[best[rows] < k]
                best[better], node[better] = k, piece[better]
            lone = unknown[:, j - 1]
            best[lone], node[lone] = 1, self.byte_id[data[lone, j - 1]]
            back[:, j], last[:, j] = best, node
        out = np.empty((n, size), np.int32)
        place, used = np.full(n, size), np.zeros(n, np.int64)
        live = np.arange(n)
        while len(live):
            at = place[live]
            step = back[live, at]
            if not step.all():
                raise ValueError("a word has no path through the pieces")
            used[live] += 1
            out[live, size - used[live]] = last[live, at]
            place[live] = at - step
            live = live[place[live] > 0]
        taken = np.arange(size) >= (size - used)[:, None]
        return out[taken], used

    def _long(self, word: bytes):
        """The same lattice for one long word, node by node."""
        last, back = [-2], [0]
        lengths = list(self.table)
        size = len(word)
        lone = np.zeros(size, bool)
        i = 0
        while i < size:
            b = word[i]
            k = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            if word[i: i + k] not in self.lookup:
                lone[i: i + k] = True
            i += k
        for j in range(1, size + 1):
            best, node = 0, -1
            if lone[j - 1]:
                best, node = 1, int(self.byte_id[word[j - 1]])
            else:
                found = [(k, self.lookup[word[j - k: j]]) for k in lengths if k <= j and word[j - k: j] in self.lookup]
                found = [(k, p) for k, p in found if last[j - k] != -1]
                ok = self.fits(np.array([max(last[j - k], 0) for k, _ in found], np.int64), np.array([p for _, p in found], np.int64))
                for (k, p), good in zip(found, ok):
                    if (good or j == k) and k > best:
                        best, node = k, p
            last.append(node)
            back.append(best)
        ids, j = [], size
        while j:
            if not back[j]:
                raise ValueError("a word has no path through the pieces")
            ids.append(last[j])
            j -= back[j]
        return ids[::-1]

    def encode_words(self, words: list[bytes], long: int = 96):
        """Flat ids and counts of words, equal lengths together."""
        size = np.array([len(w) for w in words])
        found: list = [None] * len(words)
        for k in np.unique(size):
            rows = np.flatnonzero(size == k)
            if k > long:
                for r in rows:
                    found[r] = np.array(self._long(words[r]), np.int32)
                continue
            data = np.frombuffer(b"".join(words[r] for r in rows), np.uint8).reshape(-1, k)
            ids, counts = self._viterbi(data)
            for r, part in zip(rows, np.split(ids, np.cumsum(counts)[:-1])):
                found[r] = part
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def words(self, data, offsets) -> S.Spans:
        """Spans no piece crosses: a space opens one, and so does any neighbour that no piece holds."""
        opens = np.zeros(len(data), bool)
        opens[1:] = ~self.pair[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        opens |= data == 32
        opens[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        start = np.flatnonzero(opens)
        return S.Spans(data, offsets, start, np.r_[start[1:], len(data)][: len(start)], np.searchsorted(start, offsets))

    def merge_runs(self, ids, counts):
        """Runs of bare spaces within each text become the longest pieces from the left."""
        bare = ids == self.bare
        if not (bare[1:] & bare[:-1]).any():
            return ids, counts
        text = np.repeat(np.arange(len(counts)), counts)
        same = np.r_[False, bare[1:] & bare[:-1] & (text[1:] == text[:-1])]
        heads = np.flatnonzero(bare & ~same)
        length = np.diff(np.r_[np.flatnonzero(~same), len(ids)])[np.searchsorted(np.flatnonzero(~same), heads)]
        most = max(self.runs)
        ids, keep = ids.copy(), ~same
        for h, n in zip(heads[length > 1], length[length > 1]):
            for at in range(h, h + n, most):
                k = min(most, h + n - at)
                pieces_ = []
                while k:
                    r = max(x for x in self.runs if x <= k)
                    pieces_.append(self.runs[r])
                    k -= r
                ids[at: at + len(pieces_)] = pieces_
                keep[at: at + len(pieces_)] = True
        return ids[keep], np.bincount(text[keep], minlength=len(counts))

    def decode(self, ids, counts) -> list[bytes]:
        """The texts of concatenated ids, without the space put before each text."""
        size = self.size[ids]
        raw = self.bytes[S.ragged(self.at[ids], size)].tobytes()
        total = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        ends = np.cumsum(counts)
        cuts = total[np.r_[0, ends]]
        return [raw[i + (raw[i: i + 1] == b" "): j] for i, j in zip(cuts, cuts[1:])]


@lru_cache(maxsize=1)
def _model(path: str) -> tuple[Pieces, WordCache]:
    pieces = Pieces(path)
    return pieces, WordCache(pieces.encode_words)


def encode_column(path: str, column):
    """(first row, end row, ids, counts) of bounded pieces of a string column."""
    pieces, cache = _model(path)
    column = pc.replace_substring(column, "▁", " ")
    spaced = pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type))
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, spaced)
    for a, b, data, offsets in S.chunks(column):
        ids, counts = cache.tokens(pieces.words(data, offsets))
        yield a, b, *pieces.merge_runs(ids, counts)


def encode(docs: DataFrame, path: str, carry: list[str] = ()) -> DataFrame:
    """The carried columns, ids, n_tokens, the crc of the ids and the digest of the decoded text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def work(batches):
        for rows in batches:
            for a, b, ids, counts in encode_column(path, rows.column("__text")):
                ends = np.cumsum(counts)
                texts = _model(path)[0].decode(ids, counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).slice(a, b - a) for c in carry),
                     pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32())),
                     pa.array(counts, pa.int64()),
                     pa.array([zlib.crc32(raw[4 * (e - c): 4 * e]) for e, c in zip(ends, counts)], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
                    [*carry, "ids", "n_tokens", "ids_crc32", "decoded_sha256"])
    schema = (fields + ", " if fields else "") + "ids array<int>, n_tokens bigint, ids_crc32 bigint, decoded_sha256 string"
    return docs.selectExpr(*(f"`{c}`" for c in carry), "coalesce(text, '') AS __text").mapInArrow(work, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The table with the text of its ids; null ids give null."""
    from pyspark.sql import functions as F, types as T

    def work(batches):
        pieces = _model(path)[0]
        for rows in batches:
            column = rows.column(ids)
            flat, counts = column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0)
            texts = [t.decode("utf-8", "replace") for t in pieces.decode(flat.astype(np.int64), counts.to_numpy(zero_copy_only=False))]
            text = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays([*rows.columns, text], [*rows.schema.names, out])
    return tokens.mapInArrow(work, T.StructType([*tokens.schema.fields, T.StructField(out, T.StringType())]))


@register("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    import public_tokenizers
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
