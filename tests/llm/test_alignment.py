"""Alignment against the tokenizers' own libraries and every pair of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment
from lectern.llm.common import table

ODD = ["", None, " ", "  ", "a  b   c ", " lead", "tail  ", "\n\n a\n b", "\u2581", "x\u2581 y", "<0x41> <s> </s> <|endoftext|> a", "a\x00b c", "\x1c d \x85 e", "x" * 5000 + " y", "\u00e9 \u6f22\u5b57 \U0001f642 \ufb01", "it's we'll  don't 's", " \t \t a"]


@pytest.fixture(scope="module")
def plain():
    """ids, ends and bytes of both sides by the libraries that the vocabularies are made for."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def tokens(text):
        if not text:
            return None
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        pieces = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a], [bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if any(b"".join(p) != (" " + text).encode() for p in pieces):
            return None
        return a, b, *(np.cumsum([len(x) for x in p]).tolist() for p in pieces)

    return tokens


def by_hand(texts, tokens):
    found, counts = {}, Counter()
    for key, text in texts.items():
        if (t := tokens(text)) is None:
            found[key] = None
            continue
        a, b, ends_a, ends_b = t
        where = Counter(ends_b)
        links = [(x, y) for x, e in zip(a, ends_a) if where[e] for y, f in zip(b, ends_b) if f == e] if len(a) < 400 else [(x, b[ends_b.index(e)]) for x, e in zip(a, ends_a) if where[e]]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
            i, j = m, n
        counts.update(links)
        found[key] = (len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return {k: (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]) for k, f in found.items()}


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_same_as_by_hand(spark, small, plain):
    rng = random.Random(2)
    odd = ODD + ["".join(rng.choice("aZ09 _-\n\t\x00\x0b\x1f\x7f\u00e9\u6f22\U0001f642.,;'s\u2581\u3000  ") for _ in range(rng.randrange(60))) for _ in range(300)]
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(docs).collect()} == by_hand(texts, plain)


def test_words_that_are_forgotten_and_long_texts(spark, small, plain, monkeypatch):
    texts = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").limit(40).collect()}
    batch = alignment.pa.RecordBatch.from_pydict({"doc_id": list(texts), "text": list(texts.values())})
    want = next(alignment._aligning((None, None))(iter([batch]))).to_pylist()
    monkeypatch.setattr(alignment, "WORDS", 50)
    monkeypatch.setattr(alignment, "PART_CHARS", 100)
    monkeypatch.setattr(alignment.parts, "__defaults__", (100,))
    got = next(alignment._aligning((None, None))(iter([batch]))).to_pylist()
    assert got == want
    hand = by_hand(texts, plain)
    assert all(hand[r["doc_id"]][:3] == (r["n_a"], r["n_b"], r["n_groups"]) and hand[r["doc_id"]][6] == r["groups_sha256"] for r in want)


def test_tokens_without_bytes_are_linked_as_a_product():
    sizes = np.array([0, 1, 2, 3])
    found = alignment.align(np.array([1, 0, 2, 0]), np.array([1, 0, 1, 1, 0, 0]), sizes, sizes)
    assert found.a_stop.tolist() == [2, 4] and found.b_stop.tolist() == [2, 6]
    assert sorted(zip(found.link_a.tolist(), found.link_b.tolist())) == sorted([(x, y) for x in (1, 0) for y in (1, 0)] + [(x, y) for x in (2, 0) for y in (1, 0, 0)])
    assert "".join(found.spelling(alignment.spelled(4))) == "1,0|1,0;2,0|1,1,0,0;"


def test_pairs_are_bounded_by_the_vocabularies():
    token = lambda *pieces: alignment.Tokenizer(None, list(pieces), True)
    assert alignment.most_pairs(token(b"a", b"ba"), token(b"a", b"ca")) == 4  # (a, a) from either side, (ba, a), (a, ca)
