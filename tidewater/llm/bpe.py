"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is exactly one token that its encoding ends with. It is found among the tokens that are
suffixes of the prefix (an automaton over the vocabulary gives the longest, links from each token to its longest suffix token
give the rest): the one before which the stored last token of the shorter prefix may stand, tested on the two tokens
alone by undoing their merges from the newest. The encoding is read off backwards. Different words of a slice of
documents are walked side by side, one symbol a step, long ones each on its own; each different word is encoded once.
Which characters are letters or numbers, and their normal and lower-case forms, are asked of the library that gives the
ids to match, as Python's tables are of another version of Unicode.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from tidewater.llm.textkit import U, distinct, hash_spans, mix, slices, text_bytes, words

END = "</w>"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CACHE = 200_000
LONG_WORD = 256  # characters beyond which a word is walked on its own


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def classes(kind: str) -> str:
    r"""The code points of a class such as \p{L}, as the library knows them: ranges for a regular expression."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    others = Split(Regex(kind + "+"), "removed").pre_tokenize_str(every)
    bounds = [-1, *(ord(c) for x, _ in others for c in (x[0], x[-1])), 0x110000]
    between = [(a + 1, b - 1) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if a + 1 < b and a != 0xD7FF]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in between)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBPE:
    """The encoder, made once in a worker."""
    return WordBPE(path)


class Hashed:
    """64-bit keys to numbers by open addressing; unknown keys give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << (2 * len(keys) + 1).bit_length()
        self.mask = U(size - 1)
        self.keys, self.values = np.full(size, U((1 << 64) - 1)), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), (mix(keys) & self.mask).astype(np.int64)
        while len(todo):
            free = self.values[slot] < 0
            self.values[slot[free]], self.keys[slot[free]] = values[todo[free]], keys[todo[free]]
            lost = self.keys[slot] != keys[todo]
            todo, slot = todo[lost], (slot[lost] + 1) & int(self.mask)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = (mix(keys) & self.mask).astype(np.int64)
        k, out = self.keys[slot], self.values[slot]
        i = np.flatnonzero((k != keys) & (out >= 0))
        while len(i):
            slot[i] = (slot[i] + 1) & int(self.mask)
            k, out[i] = self.keys[slot[i]], self.values[slot[i]]
            i = i[(k != keys[i]) & (out[i] >= 0)]
        return out


class WordBPE:
    """Encoder for a vocabulary file of byte-level BPE with word ends, lower case and white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, base = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        letter, digit = classes(r"\p{L}"), classes(r"\p{N}")
        self.pieces = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACES}{letter}{digit}]+")
        self.normal = Sequence([NFC(), Lowercase()])

        def symbols(t: str) -> tuple[int, ...]:  # of the word's last byte: 256 more
            end = t.endswith(END) and t != END
            x = [base[c] for c in (t[: -len(END)] if end else t)]
            return (*x[:-1], x[-1] + 256) if end else tuple(x)

        # tokens numbered by age: bytes first, then merges in order
        seqs = {t: symbols(t) for t in vocab}
        made, pairs = {}, []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            made.setdefault(a + b, (a, b))
            pairs.append((a, b))
        order = sorted((t for t in vocab if len(seqs[t]) == 1), key=vocab.get) + list(made)
        number = {t: i for i, t in enumerate(order)}
        self.ids = np.array([vocab[t] for t in order])
        self.size = np.array([len(seqs[t]) for t in order])
        self.left, self.right = (np.array([number[made[t][k]] if t in made else i for i, t in enumerate(order)]) for k in (0, 1))
        keys = np.array([number[a] << 32 | number[b] for a, b in pairs], np.uint64)
        self.merged = Hashed(keys, np.array([number[a + b] for a, b in pairs]))
        # automaton: nodes are prefixes of tokens; fail: the longest proper suffix that is a node; out: the longest token that is a suffix
        nodes, edges, token_at = {(): 0}, {}, {}
        for t in order:
            for k in range(1, len(seqs[t]) + 1):
                p = seqs[t][:k]
                if p not in nodes:
                    nodes[p] = len(nodes)
                    edges.setdefault(nodes[p[:-1]], []).append((p[-1], nodes[p]))
            token_at[nodes[seqs[t]]] = number[t]
        go = {(a, s): b for a, x in edges.items() for s, b in x}
        self.fail, self.out = np.zeros(len(nodes), np.int64), np.full(len(nodes), -1)
        self.next_shorter = np.full(len(order), -1)
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for s, b in edges.get(a, ()):
                f = int(self.fail[a])
                while a and f and (f, s) not in go:
                    f = int(self.fail[f])
                self.fail[b] = go.get((f, s), 0) if a else 0
                shorter = self.out[self.fail[b]]
                self.out[b] = token_at.get(b, shorter)
                if b in token_at:
                    self.next_shorter[token_at[b]] = shorter
                queue.append(b)
        self.edges = go
        self.go = Hashed(np.array([a << 10 | s for a, s in go], np.uint64), np.array(list(go.values())))
        self.cache: dict[str, tuple[str, str, int]] = {}

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the encoding of the joined bytes of tokens a, b is a, b: no merge older than those inside spans the border."""
        out, at = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40)
        while len(at):
            m = self.merged.get(a.astype(np.uint64) << U(32) | b.astype(np.uint64))
            bad = (m >= 0) & (m < limit)
            out[at[bad]] = False
            a, b, at = a[~bad], b[~bad], at[~bad]
            newer, r, l = a > b, self.right[a], self.left[b]
            undo_a = newer & (r != a) | ~newer & (l == b)
            ended = (r == a) & (l == b)
            limit = np.where(undo_a, a, b + 1)[~ended]
            a, b, at = np.where(undo_a, r, a)[~ended], np.where(undo_a, b, l)[~ended], at[~ended]
        return out

    @functools.cached_property
    def _scalar(self) -> tuple:
        """The tables as plain lists and dictionaries, for one word at a time."""
        go = {a << 10 | s: b for (a, s), b in self.edges.items()}
        merged = {int(k): int(v) for k, v in zip(self.merged.keys, self.merged.values, strict=True) if v >= 0}
        return go, merged, *(x.tolist() for x in (self.fail, self.out, self.next_shorter, self.size, self.left, self.right))

    def encode_long(self, word: bytes) -> np.ndarray:
        """Token numbers of one long word."""
        go, merged, fail, out, shorter, size, left, right = self._scalar
        follows: dict[int, bool] = {}

        def may_follow(a: int, b: int) -> bool:
            limit = 1 << 40
            while True:
                if merged.get(a << 32 | b, limit) < limit:
                    return False
                r, l = right[a], left[b]
                if r == a and l == b:
                    return True
                if (a > b and r != a) or (a <= b and l == b):
                    limit, a = a, r
                else:
                    limit, b = b + 1, l

        last, node = [0] * len(word), 0
        for t, s in enumerate(word):
            s += 256 * (t == len(word) - 1)
            while (to := go.get(node << 10 | s)) is None and node:
                node = fail[node]
            node = to or 0
            c = out[node]
            while (before := t + 1 - size[c]) > 0:
                pair = last[before - 1] << 32 | c
                if (ok := follows.get(pair)) is None:
                    if len(follows) > CACHE:
                        follows.clear()
                    ok = follows[pair] = may_follow(last[before - 1], c)
                if ok:
                    break
                c = shorter[c]
            last[t] = c
        tokens, at = [], len(word) - 1
        while at >= 0:
            tokens.append(last[at])
            at -= size[last[at]]
        return np.array(tokens[::-1], np.int64)

    def encode_words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of the words, flat, and each word's bounds. Words are not empty."""
        size = np.array([len(x) for x in raw], np.int64)
        by = np.argsort(-size, kind="stable")
        sym = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        ends = np.cumsum(size)
        sym[ends - 1] += 256
        start, long = (ends - size)[by], size[by]
        last, node = np.zeros(len(sym), np.int64), np.zeros(len(raw), np.int64)
        for t in range(int(long[0]) if len(long) else 0):
            n = int(np.searchsorted(-long, -t, "left"))
            at = start[:n] + t
            s, now, todo = sym[at], node[:n].copy(), np.arange(n)
            reached = np.zeros(n, np.int64)
            while len(todo):
                to = self.go.get(now[todo].astype(np.uint64) << U(10) | s[todo].astype(np.uint64))
                stop = (to >= 0) | (now[todo] == 0)
                reached[todo[stop]] = np.maximum(to[stop], 0)
                todo = todo[~stop]
                now[todo] = self.fail[now[todo]]
            node[:n] = reached
            cand, todo = self.out[reached], np.arange(n)
            while len(todo):
                c = cand[todo]
                before = t + 1 - self.size[c]
                ok = before == 0
                i = np.flatnonzero(~ok)
                ok[i] = self._may_follow(last[start[todo[i]] + before[i] - 1], c[i])
                last[at[todo[ok]]] = c[ok]
                todo = todo[~ok]
                cand[todo] = self.next_shorter[cand[todo]]
        # back-pointers
        marks, at, todo = np.zeros(len(sym), bool), start + long - 1, np.arange(len(raw))
        while len(todo):
            marks[at] = True
            at = at - self.size[last[at]]
            more = at >= start[todo]
            at, todo = at[more], todo[more]
        return last[marks], np.append(0, np.cumsum(marks))[np.append(0, ends)]

    def _pieces(self, chunk: str) -> list:
        """Words, and ids of special tokens, of a chunk without ASCII white space."""
        if self.split_special and "<|" in chunk:
            out, at = [], 0
            for m in self.split_special.finditer(chunk):
                out += [*self._pieces_plain(chunk[at : m.start()]), self.special[m[0]]]
                at = m.end()
            return out + self._pieces_plain(chunk[at:])
        return self._pieces_plain(chunk)

    def _pieces_plain(self, chunk: str) -> list[str]:
        if chunk.isascii():
            low = chunk.lower()
            return [low] if low.isalpha() else self.pieces.findall(low)
        return self.pieces.findall(self.normal.normalize_str(chunk))

    def render(self, chunks: list[str]) -> tuple[list[str], list[str], np.ndarray]:
        """Of each chunk: ids joined by spaces, tokens joined by spaces, and how many."""
        split = [self._pieces(c) for c in chunks]
        if len(self.cache) > CACHE:
            self.cache.clear()
        cache = self.cache
        new = list({w for x in split for w in x if isinstance(w, str) and w not in cache})
        long = [w for w in new if len(w) > LONG_WORD]
        for w in long:
            x = self.ids[self.encode_long(w.encode())].tolist()
            cache[w] = (" ".join(map(str, x)), " ".join([self.names[k] for k in x]), len(x))
        if long:
            new = [w for w in new if len(w) <= LONG_WORD]
        if new:
            tokens, at = self.encode_words([w.encode() for w in new])
            ids = self.ids[tokens].tolist()
            names, at = self.names, at.tolist()
            for w, i, j in zip(new, at[:-1], at[1:], strict=True):
                x = ids[i:j]
                cache[w] = (" ".join(map(str, x)), " ".join([names[k] for k in x]), j - i)
        for i in self.special.values():
            cache[i] = (str(i), self.names[i], 1)
        a, b, n = [], [], []
        for x in split:
            if len(x) == 1:
                p, q, k = cache[x[0]]
            else:
                y = [cache[w] for w in x]
                p, q, k = " ".join([z[0] for z in y]), " ".join([z[1] for z in y]), sum(z[2] for z in y)
            a.append(p)
            b.append(q)
            n.append(k)
        for w in long:
            del cache[w]
        return a, b, np.array(n, np.int64)


def _encode(path: str):
    def go(batches):
        bpe = word_bpe(path)
        for rows in slices(batches, size=6 << 20):
            data, offs = text_bytes(rows.column(1))
            buf, s, e, w = words(data, offs)
            first, place = distinct(hash_spans(buf, s, e))
            raw = buf.tobytes()
            ids, _, n = bpe.render([raw[i:j].decode() for i, j in zip(s[first].tolist(), e[first].tolist(), strict=True)])
            flat = pa.array(np.array(" ".join(ids).split(), np.int32))
            each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), flat)
            total = np.append(0, np.cumsum(n[place]))
            out = pa.ListArray.from_arrays(pa.array(total[w], pa.int32()), each.take(pa.array(place, pa.int64())).flatten())
            yield pa.RecordBatch.from_arrays([rows.column(0), out], ["doc_id", "ids"])

    return go


def _decode(path: str):
    def go(batches):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        names = pa.array([known.get(i) for i in range(max(known) + 1)], pa.string())
        for b in batches:
            lists = b.column(1)
            at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(lists.flatten()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pc.binary_join(tokens, " ")], ["doc_id", "ids", "text"])

    return go


def _decode_given(path: str):
    """As _decode, of rows (doc_id, given, ids): the text of `ids`, beside the ids that were given."""
    decoded = _decode(path)

    def go(batches):
        for b in batches:
            for x in decoded([b.select(["doc_id", "ids"])]):
                yield pa.RecordBatch.from_arrays([x.column(0), b.column(1).field(0), x.column(2)], ["doc_id", "ids", "text"])

    return go


def _digest(path: str):
    """Encodes and decodes one after the other in one worker: two would take more memory than an executor has."""
    encoded, decoded = _encode(path), _decode(path)

    def go(batches):
        for b in decoded(encoded(batches)):
            ids = b.column(1)
            joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.values.cast(pa.string())), " ")
            sha = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in c], pa.string()) for c in (joined, b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(ids).cast(pa.int64()), *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return go


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every whole text, null as empty.

    Runs where the rows are, without a shuffle. The vocabulary file lies at `path` on every executor. Rows are encoded each, repeated
    ones alike; null ids are kept. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_encode(path), "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the ids' texts, as decode() gives them. Ids that the vocabulary does not have, as null and negative ones, are
    passed over, as its own library does; a null list counts as an empty one. Rows are decoded each, repeated ones alike; null
    doc_ids are kept."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    known = {*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"])}
    gaps = [i for i in range(max(known)) if i not in known]
    there = lambda i: i.isNotNull() & i.between(0, max(known)) & ~i.isin(gaps)
    ids = F.filter(F.coalesce(F.col("ids").cast("array<int>"), F.array().cast("array<int>")), there)
    text = encoded.select("doc_id", "ids", ids.alias("_known")).withColumn("ids", F.col("ids").cast("array<int>"))
    return text.select("doc_id", F.struct("ids").alias("given"), F.col("_known").alias("ids")).mapInArrow(_decode_given(path), "doc_id long, ids array<int>, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what bpe_encode and bpe_decode give; of empty strings where a text has no tokens."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(bpe: WordBPE, text: str) -> list[int]:
    """A text's ids."""
    ids, _, _ = bpe.render([c for c in re.split(r"[\t-\r ]+", text) if c])
    return [int(i) for x in ids for i in x.split()]


def decode(bpe: WordBPE, ids: list[int]) -> str:
    """As a vocabulary without a decoder is decoded: its tokens joined by spaces."""
    return " ".join(bpe.names[i] for i in ids)


def op2_bpe(spark, sf_dir):
    import public_tokenizers

    from tidewater.llm.store import table

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
