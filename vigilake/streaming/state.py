"""Keyed state of streams: what each key remembers, in state variables that grow or expire by themselves.

The processors take the rows of a key batch by batch and sort them by their own order, since
a shuffle does not keep it. State is in the state store; a restarted query goes on from it.
"""

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.trace import LOOKBACK, REPEATS

# Rows of a key that are handed on at a time.
ROWS = 10_000


def _sorted(batches: Iterator[pd.DataFrame], order: str, columns: tuple[str, ...]) -> list[tuple]:
    rows = [row for batch in batches for row in zip(batch[order], *(batch[c] for c in columns))]
    rows.sort(key=lambda row: row[0])
    return rows


def _frames(rows: list[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), ROWS):
        yield pd.DataFrame(rows[at : at + ROWS], columns=columns)


class CircularLog(StatefulProcessor):
    """A log's sequence numbers per session and its retry loops.

    recent: the last LOOKBACK eligible (op, target), oldest first. sessions: a counter per
    session that expires when its session was silent for ``session_ttl_ms``.
    """

    def __init__(self, session_ttl_ms: int | None):
        self.session_ttl_ms = session_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "op string, target string")
        self.sessions = handle.getMapState("sessions", "session_id string", "seq bigint", self.session_ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(((op, target) for op, target in self.recent.get()), maxlen=LOOKBACK) if self.recent.exists() else deque(maxlen=LOOKBACK)
        counts, out = {}, []
        for line_no, session, op, target in _sorted(rows, "line_no", ("session_id", "op", "target")):
            if session not in counts:
                counts[session] = self.sessions.getValue((session,))[0] if self.sessions.containsKey((session,)) else 0
            counts[session] += 1
            usable = bool(op) and bool(target)
            circular = usable and target != "none" and recent.count((op, target)) + 1 >= REPEATS
            if usable:
                recent.append((op, target))
            out.append((key[0], line_no, counts[session], circular))
        for session, seq in counts.items():
            self.sessions.updateValue((session,), (seq,))
        if recent:
            self.recent.put(list(recent))
        yield from _frames(out, ["file", "line_no", "seq", "circular"])

    def close(self) -> None:
        pass


class Idle:
    """A timer that is moved on with every batch of its key."""

    def __init__(self, handle: StatefulProcessorHandle, idle_ms: int):
        self.handle, self.idle_ms = handle, idle_ms

    def move(self, timer_values, before: int) -> int:
        if before:
            self.handle.deleteTimer(before)
        due = timer_values.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        return due


class StreamAssembler(StatefulProcessor):
    """The text of a stream, handed on when it ends or falls silent.

    texts: the texts of a delta stream, one element a chunk, so state grows by what arrives.
    head: vendor, the text that a cumulative stream has reached, and the timer that is set.
    It takes and gives rows, as LabelledDates does.
    """

    row = Row("stream_id", "vendor", "text")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", "text string")
        self.head = handle.getValueState("head", "vendor string, reached string, due bigint")
        self.idle = Idle(handle, self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.head.get()
        vendor, reached, due = known or ("", "", 0)
        ended, added = False, []
        for _, vendor, text, last in sorted(((row["seq"], row["vendor"], row["text"], row["last"]) for row in rows), key=lambda row: (row[0] is not None, row[0])):
            ended = ended or bool(last)
            if text and vendor == "chatgpt":
                reached = text
            elif text:
                added.append((text,))
        if not ended:
            if added:
                self.texts.appendList(added)
            self.head.update((vendor, reached, self.idle.move(timerValues, due)))
            return
        # A stream that comes whole in one batch has no state to look into.
        whole = (self._whole(vendor, reached) if known else reached if vendor == "chatgpt" else "") + ("" if vendor == "chatgpt" else "".join(t for (t,) in added))
        if known:
            self.idle.handle.deleteTimer(due)
            self._clear()
        yield from self._told(key, vendor, whole)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        vendor, reached, _ = self.head.get()
        whole = self._whole(vendor, reached)
        self._clear()
        yield from self._told(key, vendor, whole)

    def _whole(self, vendor: str, reached: str) -> str:
        return reached if vendor == "chatgpt" else "".join(t for (t,) in self.texts.get()) if self.texts.exists() else ""

    def _clear(self) -> None:
        self.texts.clear()
        self.head.clear()

    def _told(self, key, vendor: str, text: str) -> Iterator[Row]:
        if text:
            yield self.row(key[0], vendor, text)

    def close(self) -> None:
        pass


# The beginnings a labelled date can have at the end of a text, for the pattern in operators/sanitize.py.
_LABELS = ("dob", "date of birth", "born")
_SEPARATORS = r"[:\s,]+"


def _beginnings(word: str) -> str:
    """Pattern of all non-empty beginnings of a word."""
    out = ""
    for letter in reversed(word):
        out = re.escape(letter) + (f"(?:{out})?" if out else "")
    return out


def open_label_pattern() -> re.Pattern:
    """What may still become a labelled date, up to the end of the text, or a date that may still get longer."""
    date = r"(?:\d{1,2}(?:[/-](?:\d{1,2}(?:[/-]\d{0,3})?)?)?|\d{3}|\d{4}(?:-(?:\d{1,2}(?:-\d?)?)?)?)"
    started = "|".join(_beginnings(w) for w in _LABELS)
    named = rf"(?:{'|'.join(_LABELS)}|born\s+on)"
    on = r"born\s+(?:o(?:n)?)?"
    return re.compile(rf"\b(?:{started}|{on}|{named}{_SEPARATORS}{date}?)\Z", re.IGNORECASE | re.ASCII)


def _neighbour(text: str) -> str:
    """A character that ends or goes on a word as the last one of ``text`` does, and starts no label."""
    return "0" if text[-1].isalnum() or text[-1] == "_" else " "


class LabelledDates(StatefulProcessor):
    """Chunks of a stream cut anew so that no labelled date lies in two of them.

    held: the end of the text so far that may be the beginning of one, what kind of character
    is before it, and the timer. A held end is as long as the longest beginning that fits.
    Streams are many and their batches short, so it takes and gives rows: a frame for each would cost more than the work.
    """

    row = Row("stream_id", "seq", "part", "before", "data")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "before string, text string, seq bigint, due bigint")
        self.idle = Idle(handle, self.idle_ms)
        self.open = open_label_pattern()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.held.get()
        before, text, seq, due = known or ("", "", 0, 0)
        ended = False
        for seq, data, last in sorted(((row["seq"], row["data"], row["last"]) for row in rows), key=lambda row: row[0]):
            ended = ended or bool(last)
            text += data or ""
            # The character before decides whether a word starts here.
            found = None if last else self.open.search(before + text, len(before))
            cut = found.start() - len(before) if found else len(text)
            released, text = text[:cut], text[cut:]
            yield self.row(key[0], seq, 0, before, released)
            before = _neighbour(released) if released else before
        if ended:
            if text:
                yield self.row(key[0], seq, 1, before, text)
            if known:
                self.idle.handle.deleteTimer(due)
                self.held.clear()
        else:
            self.held.update((before, text, seq, self.idle.move(timerValues, due)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        before, text, seq, _ = self.held.get()
        self.held.clear()
        if text:
            yield self.row(key[0], seq, 1, before, text)

    def close(self) -> None:
        pass
