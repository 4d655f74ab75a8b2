"""Acknowledgement in a stream: completions of records come in any order, and take effect by position.

Input rows are completions (group, position, done_us, outcome ACK or NACK, a sequence number). Positions of a group have no gaps. What
is kept of a group is its head, the next position to take effect, and the completions beyond it: up to KEPT of them one by one, more in
blocks of positions, which are read and written whole. Blocks that have been drained are removed, so state is bounded by what is in
flight. A task holds a group's new completions of one micro-batch, which the source's rows a batch limit, and KEPT others and a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Completions beyond the head that are kept one by one; positions of a block; a place of a block without a completion.
KEPT, BLOCK, NONE = 4096, 4096, -(1 << 63)


def _said(rows) -> list:
    return sorted(rows, key=lambda r: (r.done_us, r.seq))


class Ordered(StatefulProcessor):
    """A completion takes effect when all before it have; the first completion of a position counts.

    With immediate errors a NACK takes effect at once (a row without drained_us), and its slot is freed in order (a row without
    executed_us).
    """

    def __init__(self, out: list[str], start: int, immediate_errors: bool):
        self.out, self.start, self.immediate = Row(*out), start, immediate_errors

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "off bigint, last_us bigint")
        self.beyond = handle.getListState("beyond", "off bigint, done_us bigint, outcome string")
        self.blocks = handle.getMapState("blocks", "n bigint", "held binary")  # a number a position: 2 * done_us, and 1 more for a NACK

    def _block(self, n: int) -> np.ndarray | None:
        return np.frombuffer(self.blocks.getValue((n,))[0], np.int64).copy() if self.blocks.containsKey((n,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head, last = self.head.get() if self.head.exists() else (self.start, None)
        few = {x[0]: (x[1], x[2]) for x in self.beyond.get()} if self.beyond.exists() else {}
        kept, new = len(few), []
        rows = [r for r in _said(rows) if r.off >= head]
        blocks: dict[int, np.ndarray | None] = {}
        for r in sorted(rows, key=lambda r: r.off // BLOCK):  # stable: of a position the first stays first
            n = r.off // BLOCK
            if n not in blocks:
                blocks = {n: self._block(n)}
            if r.off not in few and (blocks[n] is None or blocks[n][r.off % BLOCK] == NONE):
                few[r.off] = (r.done_us, r.outcome)
                new.append(r)
        if self.immediate:
            for r in _said(r for r in new if r.outcome == "NACK"):
                yield self.out(key[0], r.off, r.outcome, r.done_us, None)
        if few:
            blocks, was = {}, head
            while True:
                n = head // BLOCK
                if head in few:
                    done_us, outcome = few.pop(head)
                elif head == was and not blocks:
                    break  # what was kept did not begin with the head
                else:
                    if n not in blocks:
                        blocks = {n: self._block(n)}
                    if blocks[n] is None or blocks[n][head % BLOCK] == NONE:
                        break
                    x = int(blocks[n][head % BLOCK])
                    done_us, outcome = x >> 1, ("ACK", "NACK")[x & 1]
                last = done_us if last is None else max(last, done_us)
                yield self.out(key[0], head, outcome, None if self.immediate and outcome == "NACK" else last, last)
                head += 1
                if head % BLOCK == 0 and self.blocks.containsKey((n,)):
                    self.blocks.removeKey((n,))
        if len(few) > KEPT:
            self._put_away(few)
            few = {}
        if few:
            self.beyond.put([(off, *x) for off, x in sorted(few.items())])
        elif kept:
            self.beyond.clear()
        self.head.update((head, last))

    def _put_away(self, few: dict[int, tuple[int, str]]) -> None:
        off = np.fromiter(few, np.int64, len(few))
        held = np.fromiter((2 * done_us + (outcome == "NACK") for done_us, outcome in few.values()), np.int64, len(few))
        by = np.argsort(off)
        off, held = off[by], held[by]
        at = np.flatnonzero(np.diff(off // BLOCK, prepend=-1))
        for i, j in zip(at, [*at[1:], len(off)], strict=True):
            n = int(off[i]) // BLOCK
            x = self._block(n)
            x = np.full(BLOCK, NONE, np.int64) if x is None else x
            x[off[i:j] % BLOCK] = held[i:j]
            self.blocks.updateValue((n,), (x.tobytes(),))

    def close(self) -> None:
        pass


class Cumulative(StatefulProcessor):
    """A completion speaks for all positions before it that have none yet; so the head is all that is kept."""

    def __init__(self, out: list[str], start: int):
        self.out, self.start = Row(*out), start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "off bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        head = self.head.get()[0] if self.head.exists() else self.start
        for r in _said(rows):
            for off in range(head, r.off + 1):
                yield self.out(key[0], off, r.outcome, r.done_us, r.done_us)
            head = max(head, r.off + 1)
        self.head.update((head,))

    def close(self) -> None:
        pass


def acknowledged(completions: DataFrame, kind: str = "ORDERED", group: str = "part", immediate_errors: bool = True, start: int = 0) -> DataFrame:
    """A stream (group, off, outcome, executed_us, drained_us) of what takes effect, from a stream of completions (group, off, done_us,
    outcome, seq). ORDERED or MULTIPLE, as operators.ack.strategy names them.

    ORDERED does not depend on the order in which completions come. MULTIPLE does, as the queue does: which signal comes first
    decides; within a batch that is the earlier done_us, then the smaller seq. Rows without done_us are no completions.
    Needs the RocksDB state store.
    """
    if kind not in ("ORDERED", "MULTIPLE"):
        raise ValueError(kind)
    out = T.StructType([T.StructField(group, completions.schema[group].dataType), *T.StructType.fromDDL("off bigint, outcome string, executed_us bigint, drained_us bigint").fields])
    processor = Ordered(out.names, start, immediate_errors) if kind == "ORDERED" else Cumulative(out.names, start)
    x = completions.where("done_us is not null").select(group, "off", "done_us", "outcome", "seq")
    return x.groupBy(group).transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="None")
