"""Totals of texts come from their units, and tables start from the longest prefix seen before."""

import random

import sentencepiece
from vigilake.llm import tokens


class Looked(dict):
    """A store that counts how often it is asked."""

    asked = 0

    def get(self, key):
        self.asked += 1
        return super().get(key)


def test_totals_equal_the_library_and_the_last_prefix():
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    counter, rng = tokens.PieceCounter(tokens.model_path()), random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "é", "中", "😀", "▁", "ing", "XY", "23", "\t", "\0", "<s>", "!!", ".", "sch", "ment", "x" * 30, "\ud800"]
    for turn in range(400):
        if turn == 200:
            counter.states.clear()
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        counts = counter.prefix_counts(text).tolist()
        assert counter.total(text) == counts[-1]
        for budget in (0, 1, 2, 3, 5, 9, 40):
            assert counter.fitting(text, budget) == tokens.longest_within(counter.prefix_counts(text), budget)
        if "\ud800" not in text:
            assert counts == [len(model.encode(text[:p])) for p in range(len(text) + 1)]


def test_a_known_prefix_is_found_at_once():
    counter = tokens.PieceCounter(tokens.model_path())
    word = "▁understandingly"
    before = counter.table(word)
    counter.states = Looked(counter.states)
    assert counter.table(word + "s")[:-1] == before
    assert counter.states.asked <= 2


def test_texts_within_the_budget_lay_out_no_prefixes(spark):
    rows = [(1, "a small text"), (2, "word " * 60), (3, ""), (4, None), (5, "one two three four")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    for budget in (0, 4, 20):
        for r in tokens.with_budget(docs, budget).collect():
            text = r.text or ""
            within = [p for p in range(len(text) + 1) if len(model.encode(text[:p])) <= budget]
            assert (r.n_tokens, r.fitting_chars) == (len(model.encode(text)), within[-1])
