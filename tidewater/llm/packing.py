"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows are cut off first; what is left goes to the open
window that it fills best. If it fits none, the fullest is filled up with its head, unless the gap is too small to be worth a
cut, and emitted. Windows still open at the end of the partitions are merged over groups of neighbouring partitions, so that no
task gathers more than a fixed number of windows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import cut

OPEN, LEAST_CUT, MERGED = 32, 4, 64
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
NAMES = [x.split()[0] for x in PIECE.split(", ")]
HELD = 4_000
LONG = 1 << 20
#: The characters that the vocabulary's expression takes as white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLANK = 1 << 14  # white space in a row from which it is cut out


class Tokens:
    """ids of the byte-level vocabulary at `path`, by its ranks; the same as the file gives in its own library."""

    def __init__(self, path: str):
        import json

        import tiktoken

        from tidewater.llm.bpe import byte_symbols

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        base, special = byte_symbols(), {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(base[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.border = re.compile(r"(?<=\S)(?= )")  # tokens never reach over one
        self.special, self.blank = tuple(special), re.compile(f"[{WHITE}]{{{BLANK},}}")

    def __call__(self, text: str) -> np.ndarray:
        """A long run of white space is a piece of its own: the expression would go back over it. Its last character belongs to
        what follows, but for a special token or the end."""
        parts, at = [], 0
        for m in self.blank.finditer(text):
            end = m.end() if m.end() == len(text) or text.startswith(self.special, m.end()) else m.end() - 1
            parts += [self._plain(text[at : m.start()]), np.array(self.encoding._encode_single_piece(text[m.start() : end].encode()), "<u4")]
            at = end
        return np.concatenate([*parts, self._plain(text[at:])]) if parts else self._plain(text)

    def _plain(self, text: str) -> np.ndarray:
        one = lambda x: np.array(self.encoding.encode(x, allowed_special="all"), "<u4")
        if len(text) <= LONG:
            return one(text)
        parts, at = [], 0
        while len(text) - at > LONG:
            m = self.border.search(text, at + LONG)
            if not m:
                break
            parts.append(one(text[at : m.start()]))
            at = m.start()
        return np.concatenate([*parts, one(text[at:])])


class Packer:
    def __init__(self, size: int, opened: int, least_cut: int, first_id: int):
        self.size, self.opened, self.least_cut, self.next_id = size, opened, least_cut, first_id
        self.open: list[list] = []  # [used, pieces]
        self.out: list[tuple] = []

    def piece(self, doc, start, ids, total, offset):
        return (doc, start, len(ids), total, offset, ids)

    def emit(self, pieces: list[tuple]) -> None:
        self.out += [(*p[:4], self.next_id, *p[4:]) for p in pieces]
        self.next_id += 1

    def add(self, doc: int | None, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids) >= self.size:
            self.emit([self.piece(doc, start, ids[: self.size], total, 0)])
            ids, start = ids[self.size :], start + self.size
        while len(ids):
            best = max((w for w in self.open if w[0] + len(ids) <= self.size), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.opened:
                self.open.append(best := [0, []])
            if best is None:
                full = max(self.open, key=lambda w: w[0])
                gap = self.size - full[0]
                if gap >= self.least_cut:
                    full[1].append(self.piece(doc, start, ids[:gap], total, full[0]))
                    ids, start = ids[gap:], start + gap
                self.open.remove(full)
                self.emit(full[1])
                continue
            best[1].append(self.piece(doc, start, ids, total, best[0]))
            best[0] += len(ids)
            if best[0] == self.size:
                self.open.remove(best)
                self.emit(best[1])
            return


def _table(rows: list[tuple], left: list[tuple]) -> pa.RecordBatch:
    """Pieces of finished sequences, whose group is null, and of windows left open."""
    cols = list(zip(*((*x[:6], x[6].tobytes(), *x[7:]) for x in [*((*r, None) for r in rows), *left]), strict=True)) or [[]] * 8
    kinds = [*[pa.int64()] * 6, pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "group"])


def _pack(path: str, size: int, opened: int, least_cut: int, last_id: int):
    def go(batches):
        tokens, part = Tokens(path), TaskContext.get().partitionId()
        p = Packer(size, opened, least_cut, part << 32)
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p.add(doc, np.append(tokens(text.as_py() or ""), np.uint32(last_id)).astype("<u4"))
                if len(p.out) > HELD:
                    yield _table(p.out, [])
                    p.out = []
        left = [(*x[:4], -1, *x[4:], part // MERGED) for w in p.open for x in w[1]]
        yield _table(p.out, left)

    return go


def _merge(size: int):
    def go(key: tuple, left: pa.Table) -> pa.Table:
        rows = list(zip(*(left.column(x).to_pylist() for x in ("doc_id", "start", "length", "doc_tokens", "ids")), strict=True))
        rows.sort(key=lambda r: (-r[2], r[0] is None, r[0] or 0, r[1]))
        p = Packer(size, 1, 1, -1 - (key[0].as_py() << 32 | 0x7FFFFFFF))
        for doc, start, _, total, ids in rows:
            p.add(doc, np.frombuffer(ids, "<u4"), start, total)
        for w in p.open:
            p.emit(w[1])
        return pa.Table.from_batches([_table(p.out, [])]).select(NAMES)

    return go


def pack(docs: DataFrame, path: str, size: int = 1024, opened: int = OPEN, least_cut: int = LEAST_CUT, last_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ids are the piece's own, 32 bits each, little-endian; a sequence is its pieces' ids in order of offset. ids_crc32 is theirs.

    A document is its text's ids, null as empty, and then `last_id`; each id lies in one piece and a sequence holds `size` ids at
    most, without gaps from 0 on. sequence_id is unique, not dense; negative ones come from merged leftovers. Rows with a null
    id keep it. Repeated rows are packed each; other columns are ignored; an empty table gives no rows. Long texts are cut
    in as many windows as they fill.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    done = cut(docs.mapInArrow(_pack(path, size, opened, least_cut, last_id), f"{PIECE}, group long"), "packed")
    merged = done.where("group is not null").groupBy("group").applyInArrow(_merge(size), PIECE)
    whole = done.where("group is null").select(*NAMES).unionByName(merged)
    return whole.select(*NAMES[:3], F.crc32("ids").alias("ids_crc32"), *NAMES[3:])


def op9_packing(spark, sf_dir):
    import public_tokenizers

    from tidewater.llm.store import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
