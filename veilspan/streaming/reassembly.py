"""Payloads between a start and an end marker, delivered in chunks (STR2, STR3).

Every byte goes on: text outside the markers, the markers (unless unframed),
and payloads that are open or above the limit pass through as they are; the
other payloads go through a redactor first.  A chunk that is delivered twice
counts once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veilspan.functions.spans import locate
from veilspan.functions.windows import BLOCK_ROWS, running_max, running_sum

# The markers and the largest payload in bytes.
START, END = "\x1b[200~", "\x1b[201~"
LIMIT = 1024 * 1024
_MARK = "\x1b\\[20[01]~"
_KEEP = len(START) - 1


def _once(chunks: DataFrame) -> DataFrame:
    """Each (session, seq) once; sources that deliver at least once repeat chunks."""
    return chunks.groupBy("session", "seq").agg(F.min(F.coalesce("chunk", F.lit(""))).alias("chunk"))


def _bounds(chunks: DataFrame) -> DataFrame:
    """Chunks with the byte offset of their first byte in the session."""
    block = F.floor(F.col("seq") / BLOCK_ROWS)
    size = F.octet_length("chunk").cast("bigint")
    ended = running_sum(chunks, ["session"], block, [F.col("seq")], size, "_stop")
    return ended.withColumn("_from", F.col("_stop") - size)


def marker_events(chunks: DataFrame) -> DataFrame:
    """(session, at, kind): markers by byte offset, also when split over chunks.

    Each chunk is searched together with the last bytes before it.  Those are
    taken from up to five earlier chunks; the first chunks of a block get them
    from the ends of the blocks before.
    """
    block = F.floor(F.col("seq") / BLOCK_ROWS)
    rows = chunks.filter(F.octet_length("chunk") > 0).withColumn("_block", block)
    fields = F.struct("seq", "chunk", "_from")
    lasts = (
        rows.withColumn(
            "_rank",
            F.row_number().over(Window.partitionBy("session", "_block").orderBy(F.desc("seq"))),
        )
        .filter(F.col("_rank") <= _KEEP)
        .groupBy("session", "_block")
        .agg(F.collect_list(fields).alias("_lasts"))
    )
    # a block holds a chunk at least, so five earlier blocks are enough
    earlier = Window.partitionBy("session").orderBy("_block").rowsBetween(-_KEEP, -1)
    carried = F.slice(F.sort_array(F.flatten(F.collect_list("_lasts").over(earlier)), False), 1, _KEEP)
    tails = lasts.select("session", "_block", carried.alias("_c")).select(
        "session", "_block", F.inline_outer("_c"), F.lit(True).alias("_copy")
    ).filter("seq is not null")
    both = rows.select(
        "session", "_block", "seq", "chunk", "_from", F.lit(False).alias("_copy")
    ).unionByName(tails)
    order = Window.partitionBy("session", "_block").orderBy("seq")
    before = F.concat_ws("", *[F.lag("chunk", i).over(order) for i in range(_KEEP, 0, -1)])
    seen = both.withColumn("_tail", F.right(before, F.lit(_KEEP))).filter("not _copy")
    text = F.concat("_tail", "chunk")
    return (
        seen.withColumn("_m", locate(text, _MARK))
        .select("session", "_from", F.octet_length("_tail").alias("_t"), F.inline_outer("_m"))
        .filter(F.col("end") > F.col("_t"))
        .select(
            "session",
            (F.col("_from") - F.col("_t") + F.col("start")).alias("at"),
            (F.col("value") == START).alias("is_start"),
        )
    )


def payload_ranges(chunks: DataFrame) -> DataFrame:
    """(session, payload_no, start, end): byte ranges between the markers.

    A payload opens at a start marker whose last earlier marker is not a start,
    and closes at the next end marker.
    """
    events = marker_events(chunks)
    block = F.floor(F.col("at") / (BLOCK_ROWS * 100))
    this = F.struct("at", "is_start")
    order = Window.partitionBy("session", F.floor(F.col("at") / (BLOCK_ROWS * 100))).orderBy("at")
    lasts = events.groupBy("session", block.alias("_b")).agg(F.max(this).alias("_end_of_block"))
    carry = lasts.select(
        "session", "_b",
        F.lag("_end_of_block").over(Window.partitionBy("session").orderBy("_b")).alias("_carry"),
    )
    flagged = (
        events.withColumn("_prev", F.lag(this).over(order))
        .withColumn("_b", block)
        .join(carry, ["session", "_b"], "left")
        .withColumn("_was_start", F.coalesce(F.col("_prev.is_start"), F.col("_carry.is_start"), F.lit(False)))
        .drop("_prev", "_carry", "_b")
    )
    opens = F.col("is_start") & ~F.col("_was_start")
    closes = ~F.col("is_start") & F.col("_was_start")
    turns = flagged.withColumn("_opens", opens).filter(opens | closes)
    numbered = running_sum(
        turns, ["session"], block, [F.col("at")], F.col("_opens").cast("bigint"), "payload_no"
    )
    return numbered.groupBy("session", "payload_no").agg(
        (F.min("at") + len(START)).alias("start"),
        F.max(F.when(~F.col("_opens"), F.col("at"))).alias("end"),
    )


def _pieces(placed: DataFrame, ranges: DataFrame, framed: bool = True) -> DataFrame:
    """(session, segment, seq, piece): each chunk cut where payloads begin and end.

    Segment 0 is the text before the first payload; payload n is segment
    2n - 1 and the text after it, from its end marker on, is segment 2n.
    Unframed, the markers are cut out as well and left away.
    Chunks and cuts are laid along the bytes of the session, so that a running
    count tells each cut its chunk and each chunk its segment; chunks and
    payloads are never paired.
    """
    bounds = [F.col("start"), F.col("end")]
    if not framed:
        bounds = [bounds[0] - len(START), *bounds, bounds[1] + len(END)]
    cuts = ranges.select("session", F.explode(F.array(*bounds)).alias("at")).filter("at is not null")
    along = placed.select(
        "session", F.col("_from").alias("at"), F.col("seq"), F.lit(1).alias("_chunk")
    ).unionByName(
        cuts.withColumns({"seq": F.lit(None).cast("bigint"), "_chunk": F.lit(0)})
    )
    block = F.floor(F.col("at") / (BLOCK_ROWS * 100))
    # a cut goes before the chunk that begins with it; empty chunks share their place
    order = [F.col("at"), F.col("_chunk"), F.col("seq")]
    cut_no = running_sum(along, ["session"], block, order, 1 - F.col("_chunk"), "_cut_no")
    counted = running_max(cut_no, ["session"], block, order, F.col("seq"), "_in_chunk")
    inside = (
        counted.filter("_chunk = 0")
        .groupBy("session", F.col("_in_chunk").alias("seq"))
        .agg(F.array_sort(F.collect_list("at")).alias("_cuts"))
    )
    begins = counted.filter("_chunk = 1").select("session", "seq", F.col("_cut_no").alias("_segment"))
    cut = placed.join(begins, ["session", "seq"]).join(inside, ["session", "seq"], "left")
    bounds = F.concat(F.array("_from"), F.coalesce("_cuts", F.expr("cast(array() as array<bigint>)")), F.array("_stop"))
    each = cut.withColumn("_b", bounds).select(
        "session", "seq", "chunk", "_from", "_segment", "_b", F.posexplode(F.slice("_b", 1, F.size("_b") - 1)).alias("_i", "_a")
    )
    size = (F.element_at("_b", F.col("_i") + 2) - F.col("_a")).cast("int")
    piece = F.substring(F.col("chunk").cast("binary"), (F.col("_a") - F.col("_from")).cast("int") + 1, size)
    segment = F.col("_segment") + F.col("_i")
    cut_up = each.filter(size > 0)
    if not framed:
        # text, start marker, payload, end marker
        cut_up = cut_up.filter(segment % 2 == 0)
        segment = segment.cast("bigint") / 2
    return cut_up.select(
        "session", segment.cast("bigint").alias("segment"), "seq", piece.cast("string").alias("piece")
    )


def redact_payloads(
    chunks: DataFrame, redact: Callable[[Column], Column], limit: int = LIMIT, framed: bool = True
) -> DataFrame:
    """(session, segment, seq, kind, text): the whole stream again, its payloads redacted (STR2, STR3, UDF5).

    ``redact`` maps the column of payload texts, and may be any redaction.
    ``kind`` is ``payload`` for a redacted one, one row each; ``outside`` for
    text between payloads with the markers; ``over`` for a payload above
    ``limit`` bytes and ``open`` for one without an end, both as they came, one
    row a chunk.  The texts of a session by (segment, seq) are its bytes, but
    for what ``redact`` changed; nothing is held back or cut.
    """
    placed = _bounds(_once(chunks))
    ranges = payload_ranges(placed)
    size = F.col("end") - F.col("start")
    kinds = ranges.select(
        "session",
        (2 * F.col("payload_no") - 1).alias("segment"),
        F.when(size <= limit, "payload").when(size > limit, "over").otherwise("open").alias("kind"),
    )
    pieces = _pieces(placed, ranges, framed).join(kinds, ["session", "segment"], "left")
    whole = (
        pieces.filter("kind = 'payload'")
        .groupBy("session", "segment")
        .agg(F.min("seq").alias("seq"), F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("p"))
        .withColumn("text", F.array_join(F.transform("p", lambda r: r["piece"]), ""))
        .select("session", "segment", "seq", F.lit("payload").alias("kind"), redact(F.col("text")).alias("text"))
    )
    rest = pieces.filter("kind is null or kind <> 'payload'").select(
        "session", "segment", "seq", F.coalesce("kind", F.lit("outside")).alias("kind"), F.col("piece").alias("text")
    )
    return whole.unionByName(rest)


def reassemble(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session, payload_no, n_bytes, overflowed, payload) of finished payloads.

    Only payloads within the limit are put together in one value; the text of a
    larger one is in ``redact_payloads``, chunk by chunk, and NULL here.
    """
    placed = _bounds(_once(chunks))
    ranges = payload_ranges(placed)
    found = ranges.filter("end is not null").select(
        "session",
        "payload_no",
        (2 * F.col("payload_no") - 1).alias("segment"),
        (F.col("end") - F.col("start")).alias("n_bytes"),
    )
    small = found.filter(F.col("n_bytes") <= limit).select("session", "segment")
    joined = (
        _pieces(placed, ranges)
        .join(small, ["session", "segment"], "left_semi")
        .groupBy("session", "segment")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("p"))
        .select("session", "segment", F.array_join(F.transform("p", lambda r: r["piece"]), "").alias("payload"))
    )
    return found.join(joined, ["session", "segment"], "left").select(
        "session",
        "payload_no",
        "n_bytes",
        (F.col("n_bytes") > limit).alias("overflowed"),
        F.when(F.col("n_bytes") <= limit, F.coalesce("payload", F.lit(""))).alias("payload"),
    )


def overflows(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session, payload_no, n_bytes) of payloads above ``limit``, finished or not: what the flag of a stream reports (STR3)."""
    placed = _bounds(_once(chunks))
    ends = placed.groupBy("session").agg(F.max("_stop").alias("_all"))
    ranges = payload_ranges(placed).join(ends, "session")
    size = F.coalesce("end", "_all") - F.col("start")
    return ranges.select("session", "payload_no", size.alias("n_bytes")).filter(F.col("n_bytes") > limit)


class _Session:
    """What a session holds between micro-batches: an unfinished payload or part of a marker, and chunks come early.

    ``unsure`` says what becomes of text whose place between the markers cannot
    be known because a chunk before it is missing, and of chunks that come
    after their place was given up: ``pass`` or ``withhold``.
    """

    def __init__(
        self,
        kept: tuple | None,
        limit: int,
        redact: Callable[[str], str],
        first_seq: int = 0,
        unsure: str = "pass",
        framed: bool = True,
        early_limit: int | None = None,
    ):
        self.inside, self.number, self.over, self.held, self.next_seq, self.torn, waiting, gaps = kept or (
            False, 0, False, "", first_seq, False, "[]", "[]"
        )
        self.waiting: dict[int, str] = {int(k): v for k, v in json.loads(waiting)}
        self.gaps: list[list[int]] = json.loads(gaps)
        self.limit, self.redact, self.framed = limit, redact, framed
        self.early_limit = limit if early_limit is None else early_limit
        self.withhold = unsure == "withhold"
        self.overflowed: list[int] = []
        self.out: list[tuple[int, str, str]] = []

    def kept(self) -> tuple:
        waiting, gaps = json.dumps(sorted(self.waiting.items())), json.dumps(self.gaps)
        return self.inside, self.number, self.over, self.held, self.next_seq, self.torn, waiting, gaps

    def _send(self, kind: str, text: str) -> None:
        if text:
            self.out.append((self.number, kind, text))

    def take_overflow(self) -> list[int]:
        """Payloads that went above the limit since the last call; each is told once."""
        told, self.overflowed = self.overflowed, []
        return told

    def _is_late(self, seq: int) -> bool:
        """Whether the place of a chunk was given up; asked once, a repeat of it is no longer late."""
        for gap in self.gaps:
            if gap[0] <= seq <= gap[1]:
                self.gaps.remove(gap)
                self.gaps += [g for g in ([gap[0], seq - 1], [seq + 1, gap[1]]) if g[0] <= g[1]]
                return True
        return False

    def take(self, rows: list[tuple[int, str]]) -> None:
        """Read chunks in the order of ``seq``; those after a gap wait for it, or until they exceed ``early_limit``.

        A chunk that was read or waits already is a repeat and is dropped.
        """
        late = ""
        for seq, chunk in sorted(rows):
            if seq >= self.next_seq:
                self.waiting.setdefault(seq, chunk)
            elif self._is_late(seq):
                late += chunk  # its place was given up: it goes on by itself
        self._send("withheld" if self.withhold else "late", late)
        ready = []
        while self.next_seq in self.waiting:
            ready.append(self.waiting.pop(self.next_seq))
            self.next_seq += 1
        self._read("".join(ready))
        if sum(map(len, self.waiting.values())) > self.early_limit:
            self._skip_gaps()

    def _skip_gaps(self) -> None:
        for seq, chunk in sorted(self.waiting.items()):
            if seq > self.next_seq:
                self.gaps.append([self.next_seq, seq - 1])
                self._tear()
            self._read(chunk)
            self.next_seq = seq + 1
        self.waiting = {}

    def _tear(self) -> None:
        """Text is missing here: until the next marker nobody knows whether the rest is inside a payload."""
        if not self.withhold:
            return
        if not self.inside or self.over:
            self._send("over" if self.inside else "withheld" if self.torn else "outside", self.held)
            self.held = ""
        self.torn = True

    def _mark(self, mark: str) -> None:
        if self.framed:
            self._send("outside", mark)

    def _read(self, new: str) -> None:
        text, at = self.held + new, 0
        while True:
            marks = (START, END) if self.torn and not self.inside else (END,) if self.inside else (START,)
            places = [(p, m) for m in marks if (p := text.find(m, at)) >= 0]
            if not places:
                break
            found, mark = min(places)
            body = text[at:found]
            if self.torn:
                self._send("withheld", body)
            elif not self.inside:
                self._send("outside", body)
            elif self.over or len(body.encode()) > self.limit:
                if not self.over:
                    self.overflowed.append(self.number)
                self._send("over", body)
            else:
                self._send("payload", self.redact(body))
            self._mark(mark)
            self.inside = mark == START
            self.number += self.inside
            self.over = self.torn = False
            at = found + len(mark)
        rest = text[at:]
        if self.inside and not (self.over or self.torn) and len(rest.encode()) > self.limit + _KEEP:
            self.over = True
            self.overflowed.append(self.number)
        if self.inside and not (self.over or self.torn):
            self.held = rest
            return
        # what could be the beginning of a marker waits for its end
        keep = max((n for m in marks for n in range(1, len(m)) if rest.endswith(m[:n])), default=0)
        cut = len(rest) - keep
        self._send("withheld" if self.torn else "over" if self.inside else "outside", rest[:cut])
        self.held = rest[cut:]

    def flush(self) -> None:
        """Nothing more is coming: gaps are given up and what is held goes on."""
        self._skip_gaps()
        self._send("withheld" if self.torn else "open" if self.inside else "outside", self.held)
        self.held = ""


OUT = "session bigint, payload_no bigint, piece_no bigint, kind string, text string, withheld string"


_OUT_ROW = Row(*(c.split()[0] for c in OUT.split(", ")))


def _millis(ts: datetime) -> int:
    return int((ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)).timestamp() * 1000)


class Reassembler(StatefulProcessor):
    """A session's state: a row of flags, the open payload in pieces, chunks come early by number, gaps given up.

    Sessions are many and small, so rows come and go as they are: a pandas
    frame for each session and batch costs many times the work on its rows.
    So do calls to the state store; chunks come early are written by one call.
    """

    def __init__(self, idle_ms: int, *options: Any):
        self.idle_ms, self.options = idle_ms, options  # of each ``_Session``

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState(
            "flags", "inside boolean, number bigint, over boolean, next_seq bigint, torn boolean, gaps string, timer bigint"
        )
        self.held = handle.getListState("held", "piece string")
        self.early = handle.getListState("early", "seq bigint, chunk string")

    def _load(self) -> tuple[_Session, int | None]:
        flags = self.flags.get()
        if flags is None:
            return _Session(None, *self.options), None
        inside, number, over, next_seq, torn, gaps, timer = flags
        held = "".join(piece for (piece,) in self.held.get())
        kept = (bool(inside), int(number), bool(over), held, int(next_seq), bool(torn), "[]", gaps)
        session = _Session(kept, *self.options)
        session.waiting = {int(seq): chunk for seq, chunk in self.early.get()}
        return session, int(timer)

    @staticmethod
    def _write(state: Any, added: list[tuple] | None, whole: list[tuple]) -> None:
        """Add rows to a list, or write it anew where ``added`` is None."""
        if added:
            state.appendList(added)
        elif added is None and whole:
            state.put(whole)
        elif added is None:
            state.clear()

    def _store(self, session: _Session, held: str, waiting: list[tuple[int, str]], timer: int) -> None:
        # an open payload only grows: what came on is added, not the whole written again
        s, now = session, list(session.waiting.items())
        more = s.held[len(held) :]
        self._write(self.held, ([(more,)] if more else []) if s.held.startswith(held) else None, [(s.held,)] if s.held else [])
        self._write(self.early, now[len(waiting) :] if now[: len(waiting)] == waiting else None, now)
        self.flags.update((s.inside, s.number, s.over, s.next_seq, s.torn, json.dumps(s.gaps), timer))

    @staticmethod
    def _rows(key: Any, session: _Session) -> Iterator[Row]:
        for i, (n, kind, text) in enumerate(session.out):
            yield _OUT_ROW(key[0], n, i, kind, None if kind == "withheld" else text, text if kind == "withheld" else None)
        for i, n in enumerate(session.take_overflow(), len(session.out)):
            yield _OUT_ROW(key[0], n, i, "overflow", None, None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        session, timer = self._load()
        held, waiting = session.held, list(session.waiting.items())
        last = timerValues.getCurrentWatermarkInMs()
        new: list[tuple[int, str]] = []
        for row in rows:
            new.append((row.seq, row.chunk or ""))
            if row.ts is not None:
                last = max(last, _millis(row.ts))
        session.take(new)
        due = last + self.idle_ms
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self._store(session, held, waiting, due)
        yield from self._rows(key, session)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        session, _ = self._load()
        session.flush()
        for state in (self.flags, self.held, self.early):
            state.clear()
        yield from self._rows(key, session)

    def close(self) -> None:
        pass


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def redact_payload_stream(
    stream: DataFrame,
    redact: Callable[[str], str],
    limit: int = LIMIT,
    idle: str = "10 minutes",
    first_seq: int = 0,
    unsure: str = "withhold",
    framed: bool = True,
    early_limit: int = LIMIT,
) -> DataFrame:
    """``redact_payloads`` on a stream of ``session, seq, ts, chunk``: (session, payload_no, piece_no, kind, text, withheld).

    Chunks are read in the order of ``seq`` from ``first_seq`` on, in whatever
    order and however often they come; a session keeps one payload within
    ``limit`` and the chunks after a gap.  A gap is given up when the chunks
    after it exceed ``early_limit`` characters, or when the session was idle for ``idle`` of
    event time; then all that is held goes on and the state is dropped.

    What a given-up chunk may have held, a start marker or the middle of a
    payload, is not known.  With ``unsure='withhold'`` the text from there to
    the next marker, and a payload with a gap in it, are of kind ``withheld``
    and stand in that column alone, as do chunks that come after they were
    given up; with ``unsure='pass'`` they go on, the latter as ``late``.

    A payload that goes above the limit gives one row of kind ``overflow``,
    when it does (STR3).  ``framed=False`` leaves the markers away.  ``redact``
    maps one text.  State is kept in RocksDB; the session's provider is set to it.
    """
    if unsure not in ("withhold", "pass"):
        raise ValueError(f"unknown policy {unsure!r}")
    stream.sparkSession.conf.set(_PROVIDER, _ROCKS)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return (
        stream.select("session", "seq", "ts", "chunk")
        .withWatermark("ts", idle)
        .groupBy("session")
        .transformWithState(
            Reassembler(idle_ms, limit, redact, first_seq, unsure, framed, early_limit), OUT, "append", "eventTime"
        )
    )


def overflow_events(redacted: DataFrame) -> DataFrame:
    """(session, payload_no): the side table of payloads above the limit, of what ``redact_payload_stream`` gives (STR3)."""
    return redacted.filter("kind = 'overflow'").select("session", "payload_no")


def reassemble_stream(stream: DataFrame, limit: int = LIMIT, idle: str = "10 minutes", first_seq: int = 0) -> DataFrame:
    """(session, payload_no, overflowed, payload) of finished payloads on a stream, and pieces of those above the limit."""
    out = redact_payload_stream(stream, lambda text: text, limit, idle, first_seq)
    return out.filter("kind in ('payload', 'over')").select(
        "session", "payload_no", (F.col("kind") == "over").alias("overflowed"), F.col("text").alias("payload")
    )
