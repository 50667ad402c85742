"""Exact token counts of every prefix of a text, by dynamic programming over a piece vocabulary.

The tokenizer merges adjacent symbols, best score first, so its tokens for a prefix
end in exactly one token, and a token may follow another exactly if encoding both
together gives those two. With c[p] the count for the first p characters, the
table is filled from the left: the last token t of prefix p is the longest piece
ending there that may follow the last token of prefix p - len(t), and
c[p] = c[p - len(t)] + 1. Text is cut where no piece spans the cut, and the table of
each distinct unit is kept, so repeated words cost one look-up.
"""

import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, pairwise
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.common import table

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# Units whose tables or totals are kept per worker; beyond that the store starts afresh.
KEPT_UNITS = 600_000
KEPT_PAIRS = 500_000
# No piece has a space after another character, or a line feed: nothing merges across these cuts.
UNIT = re.compile(r" *+[^ \n]+| +|\n")
# Prefixes of words whose state is kept per worker, and how long they may be.
KEPT_STATES = 1_000_000
MEMO_LENGTH = 24


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Prefix counts for a score-merging piece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        # Characters that follow each other inside a piece; anywhere else a cut changes nothing.
        joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        assert not any(j[1] == SPACE and j[0] != SPACE for j in joined)
        self.known = {p for p in self.score if len(p) == 1}
        assert not any("\n" in p for p in self.score)
        self.states: dict[str, bytes] = {}
        self.joined = joined
        self.rank = {p: -s for p, s in self.score.items()}
        # The last merge of every piece that the encoder can make; the others never occur.
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole, self.lengths = set(), {}
        for piece in sorted((p for p in self.score if len(p) > 1), key=len):
            if self.encode(piece) == [piece]:
                self.whole.add(piece)
                self.halves[piece] = self.last_merge
                self.lengths.setdefault(piece[-2:], set()).add(len(piece))
        for piece in self.whole:  # by three characters where a piece has them; those of two end there as well
            if len(piece) > 2:
                self.lengths.setdefault(piece[-3:], {2} if piece[-2:] in self.whole else set()).add(len(piece))
        self.lengths = {end: sorted(found, reverse=True) for end, found in self.lengths.items()}
        self.totals = Totals(self.unit_total)
        self.forget()

    def cost(self, char: str) -> int:
        """Tokens of one unmerged character: its own piece, or its bytes."""
        return 1 if char in self.known else len(char.encode("utf-8", "replace"))

    def encode(self, text: str) -> list[str]:
        """Merge adjacent symbols, best score first, leftmost among equals."""
        parts: list = list(text)
        after = [*range(1, len(parts)), -1]
        before = [*range(-1, len(parts) - 1)]
        heap: list = []

        def offer(i, j):
            if i >= 0 and j >= 0 and (s := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, parts[i] + parts[j], j))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, merged, j = heapq.heappop(heap)
            if parts[i] is None or after[i] != j or parts[i] + parts[j] != merged:
                continue
            self.last_merge = (parts[i], parts[j])
            parts[i], parts[j] = merged, None
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def follows(self, left: str, right: str) -> bool:
        """Whether encoding both texts together gives exactly these two tokens.

        Undo the merges next to the boundary, latest first. Had the two parts that lie
        at the boundary then been mergeable before the merge just undone, the encoder
        would have merged across. Among equal ranks the left place is merged first.
        """
        if SPACE in right or left.endswith(SPACE):  # runs of marks have pieces of equal rank
            return self.encode(left + right) == [left, right]
        limit = float("inf")
        while True:
            if self.rank.get(left + right, limit) < limit:
                return False
            a, b = self.merged_at(left), self.merged_at(right)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.halves[left][1]
            else:
                limit, right = b + 0.5, self.halves[right][0]

    def merged_at(self, token: str) -> float:
        return self.rank[token] if len(token) > 1 else -1.0

    def parts(self, unit: str) -> list[str]:
        """Cut a unit between characters that follow each other in no piece."""
        if self.joined.issuperset(map(add, unit, unit[1:])):
            return [unit]
        cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in self.joined), len(unit)]
        return [unit[a:b] for a, b in pairwise(cuts)]

    def table(self, unit: str) -> list[int]:
        """Tokens of every prefix of ``unit``, from its first character on, filled from the longest prefix seen before.

        The state of a prefix is its whole table, counts first and then the lengths of last tokens, a byte each.
        """
        states, size = self.states, len(unit)
        if len(states) > KEPT_STATES:
            states.clear()
        known, state = min(size, MEMO_LENGTH), None
        while known and (state := states.get(unit[:known])) is None:
            known -= 1
        counts, last = ([0, *state[:known]], [0, *state[known:]]) if known else ([0], [0])
        extend = self.extend
        for p in range(known + 1, size + 1):
            extend(unit, counts, last)
            if p <= MEMO_LENGTH:
                states[unit[:p]] = bytes(counts[1:] + last[1:])
        return counts[1:]

    def extend(self, unit: str, counts: list[int], last: list[int]) -> None:
        """Append the count of the next prefix of ``unit`` and the length of its last token."""
        p, lengths, whole = len(counts), self.lengths, self.whole
        for n in lengths.get(unit[p - 3 if p > 3 else 0 : p]) or lengths.get(unit[p - 2 if p > 2 else 0 : p], ()):
            if n > p or (token := unit[p - n : p]) not in whole:
                continue
            if n == p:
                known = True
            else:
                pair = (unit[p - n - last[p - n] : p - n], token)
                known = self.pairs.get(pair)
                if known is None:
                    known = self.follows(*pair)
                    if len(self.pairs) < KEPT_PAIRS:
                        self.pairs[pair] = known
            if known:
                counts.append(counts[p - n] + 1)
                last.append(n)
                return
        # No longer token ends here, so the last character stands alone: the encoder always has an answer.
        counts.append(counts[p - 1] + self.cost(unit[p - 1]))
        last.append(1)

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last prefix of each of its units, summed."""
        if not text:
            return 0
        if len(self.totals) > KEPT_UNITS:
            self.totals.clear()
        return sum(map(self.totals.__getitem__, UNIT.findall(" " + text.replace(SPACE, " "))))

    def fitting(self, text: str, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens: it ends in or before the last unit that begins below it."""
        units = UNIT.findall(" " + text.replace(SPACE, " ")) if text else []
        begins = [0, *accumulate(map(self.totals.__getitem__, units))]
        last = min(bisect_left(begins, budget), len(units)) - 1
        if last < 0:
            return 0
        end, total = sum(map(len, units[:last])), begins[last]
        best = end
        for part in self.parts(units[last].replace(" ", SPACE)):
            counts = self.table(part)
            best = max([best, *(end + p for p, n in enumerate(counts, 1) if total + n <= budget)])
            end, total = end + len(part), total + counts[-1]
        # Every text is counted with a space before it.
        return max(0, best - 1)

    def unit_total(self, unit: str) -> int:
        total = 0
        for part in self.parts(unit.replace(" ", SPACE)):
            state = self.states.get(part)
            total += state[len(part) - 1] if state else self.table(part)[-1]
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """c[p] for p = 0 ... len(text): tokens of the first p characters, exactly."""
        if not text:
            return np.zeros(1, np.int64)
        units = UNIT.findall(" " + text.replace(SPACE, " "))
        if len(self.number) > KEPT_UNITS:
            self.forget()
        for unit in set(units):
            if unit not in self.number:
                self.add(unit)
        numbers = np.fromiter(map(self.number.get, units), np.int64, len(units))
        # Views, not copies; they end with this call, before the store grows again.
        begin, length = np.frombuffer(self.begin, np.int64)[numbers], np.frombuffer(self.length, np.int64)[numbers]
        ends = np.cumsum(length)
        # Place of every character's count in the store: its unit's begin plus its place in the unit.
        place = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
        store = np.frombuffer(self.store, np.int32)
        totals = store[begin + length - 1]
        return np.concatenate([[0], (store[place] + np.repeat(np.cumsum(totals) - totals, length))[1:]])

    def add(self, unit: str) -> int:
        """Keep the table of a new unit; its number."""
        self.number[unit] = len(self.length)
        self.begin.append(len(self.store))
        self.length.append(len(unit))
        total = 0
        for part in self.parts(unit.replace(" ", SPACE)):
            counts = self.table(part)
            self.store.extend([total + c for c in counts] if total else counts)
            total += counts[-1]
        return self.number[unit]

    def forget(self):
        """Start an empty store of unit tables."""
        self.number: dict[str, int] = {}
        self.begin, self.length, self.store = array("q"), array("q"), array("i")


class Totals(dict):
    """Tokens of units, counted when they are first asked for."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, unit: str) -> int:
        self[unit] = found = self.count(unit)
        return found


@cache
def shared_counter(path: str) -> PieceCounter:
    """The counter of this process: a worker takes task after task, and what one has counted helps the next."""
    return PieceCounter(path)


def with_prefix_counts(docs: DataFrame, text: str = "text", out: str = "prefix_tokens", path: str | None = None) -> DataFrame:
    """Add ``out``: array<int>, its element p + 1 the tokens of the first p code points."""
    path = path or model_path()

    @F.pandas_udf("array<int>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = PieceCounter(path)
        for texts in batches:
            yield pd.Series([counter.prefix_counts(t or "").astype(np.int32) for t in texts])

    return docs.withColumn(out, counted(F.col(text)))


def tokens_at(counts: str, prefix) -> F.Column:
    """Tokens of the first ``prefix`` code points, from a column of with_prefix_counts()."""
    return F.element_at(F.col(counts), F.least(F.lit(prefix), F.size(counts) - 1) + 1)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens.

    Counts may fall from one prefix to a longer one (a merge), so all prefixes are looked at.
    """
    return int(np.flatnonzero(counts <= budget)[-1])


def with_budget(docs: DataFrame, budget: int = LIMIT, text: str = "text", path: str | None = None) -> DataFrame:
    """Add n_tokens and ``fitting_chars``, the longest prefix within ``budget``, from each text's table.

    A text within the budget is its own longest prefix, so its units' totals do; of a longer one
    only the unit that reaches the budget is looked into.
    """
    path = path or model_path()

    @F.pandas_udf("n_tokens bigint, fitting_chars bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = shared_counter(path)
        for texts in batches:
            totals = [counter.total(t or "") for t in texts]
            fitting = [len(t or "") if n <= budget else counter.fitting(t, budget) for t, n in zip(texts, totals, strict=True)]
            yield pd.DataFrame({"n_tokens": totals, "fitting_chars": fitting}, dtype="int64")

    found = docs.withColumn("__tokens", counted(F.col(text)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "fitting_chars")]
    return found.select(*kept, F.col("__tokens.n_tokens").alias("n_tokens"), F.col("__tokens.fitting_chars").alias("fitting_chars"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    counted = with_budget(docs, LIMIT)
    return counted.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fitting_chars")
