"""Nothing of a line, a URL or a vocabulary is left out."""

import random
import tracemalloc

import numpy as np
import pytest

from lectern.llm import chat, language, lmscore, urls


@pytest.mark.parametrize("lead", [0, 1, 39, 41, 60, 500])
@pytest.mark.parametrize("marker", ["User: ", "[assistant] ", "<|system|>", "### User", "**Bot**: ", "you > ", "###" + " " * 50 + "User", "a" + " " * 60 + ": "])
def test_indented_markers_are_seen(lead, marker):
    line = " " * lead + marker + ("" if marker.endswith("User") else "hi")
    assert chat.marked_role(line) is not None
    told = lambda x: chat.code_of(x, False, True) // 24  # noqa: E731 (the other features have 24 codes)
    assert told(line) == told(marker + line[lead + len(marker) :]) != told("hi")


def test_an_indented_transcript_keeps_its_turns():
    text = "\n".join(" " * 60 + x for x in ("User: what is it?", "Assistant: a thing.", "User: and why?", "Assistant: it is so."))
    flat = "\n".join(x.strip() for x in text.split("\n"))
    assert chat.decode([text]) == chat.decode([flat])


@pytest.fixture
def some():
    rng = random.Random(1)
    return ["".join(rng.choice("abc/.-?=1") for _ in range(rng.choice((0, 1, 5, 60, 700)))).encode() for _ in range(60)]


@pytest.mark.parametrize("step", [1, 3, 7, 64, 701])
def test_urls_in_steps_are_counted_and_judged_alike(monkeypatch, some, step):
    whole = urls.Counts.of(some[:30]), urls.Counts.of(some[30:])
    score = urls.Ratio(*whole).scores(some)
    monkeypatch.setattr(urls, "STEP_CHARS", step)
    parts = urls.Counts.of(some[:30]), urls.Counts.of(some[30:])
    for a, b in zip(whole, parts):
        assert all((getattr(a, k) == getattr(b, k)).all() for k in ("pair", "context", "kinds"))
    assert np.allclose(urls.Ratio(*parts).scores(some), score, rtol=1e-6, atol=1e-9)


def test_urls_that_differ_late(spark):
    lead = "q" * 5000
    good = [(i, f"http://a.org/fr/{lead}{'library' * 40}{i}") for i in range(40)]
    bad = [(100 + i, f"http://b.net/{lead}{'casino' * 40}{i}") for i in range(40)]
    new = [(1000, f"http://c.info/{lead}{'casino' * 40}"), (1001, f"http://c.info/{lead}{'library' * 40}")]
    got = {r["page_id"]: r["ratio"] for r in urls.judge(spark.createDataFrame(good + bad + new, "page_id long, url string")).collect()}
    assert got[1000] < 0 < got[1001]


def test_fitting_needs_bounded_memory():
    many = [b"x" * 4096] * 1000
    tracemalloc.start()
    urls.Counts.of(many)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120e6  # whatever the number of characters: 572e6 when a class was one step


def test_the_sample_has_a_limit_for_all_together(spark, monkeypatch):
    monkeypatch.setattr(urls, "FIT_CHARS", 300)
    rows = [(i, f"http://a{i}.org/fr/{'z' * 40}") for i in range(50)] + [(100 + i, f"http://b{i}.net/{'y' * 40}") for i in range(50)]
    asked = []
    monkeypatch.setattr(urls, "fit", lambda sample: asked.append(sample))
    urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    for verdict in ("allow", "block"):
        assert 3 <= sum(v == verdict for _, v in asked[0]) <= 6


def test_long_pieces_of_a_vocabulary_are_used():
    v = lmscore.build([("▁", -2.0), ("a", -2.0), ("▁" + "a" * 30, -1.0)], dict.fromkeys(range(256), -6.0))
    assert v.longest == 31 and lmscore.word_log_probabilities(["a" * 30], v)[0] > lmscore.word_log_probabilities(["a" * 29], v)[0]


@pytest.mark.parametrize("step", [1, 2, 5, 17, 100])
def test_letters_of_a_long_text_in_parts(monkeypatch, step):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAb\u00e9\u6f22 .,\n1\U0001f642Z ") for _ in range(rng.choice((2, 3, 50, 400)))).encode() for _ in range(60)]
    whole = [language.features([t]) for t in texts]
    monkeypatch.setattr(language, "STEP_BYTES", step)
    for t, (x, n) in zip(texts, whole):
        got, letters = language.features([t])
        assert (got == x).all() and (letters == n).all()


def test_features_of_a_long_text_need_bounded_memory():
    text = b"some words of a text " * 500_000
    tracemalloc.start()
    language.features([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # 10 MB of text; 497e6 when it was one step
