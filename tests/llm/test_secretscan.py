"""Secrets: patterns by hand, and what the battery lets through."""

import hashlib
import math
import random
import re
import string

import pytest

from lectern.llm import secretscan
from lectern.llm.common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secretscan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


PARTS = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", ":", "=", " ", "  ", "'", '"', "AKIA", "ABCD1234", "QWERTYUIOPASDFGH", "0123456789abcdef", "deadbeef", "\n", "\u00e9", "\U0001f642", "xyz", "==", ".", "-", "\u212a", "\u017fecret"]


def test_patterns_by_hand(spark, small):
    rng = random.Random(5)
    odd = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(400)] + [None, "", "token:token:abcdefghijklmnop", "AKIAAKIA" + "A" * 12, "token=" + "a" * 50_000, "f" * 50_000, "passwordtoken='abcdefghijkl'"]
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secretscan.digest(secretscan.spans(docs)).collect()}
    for r in docs.collect():
        want, have = base(r["text"]), got[r["doc_id"]]
        assert [s for s in have["spans"].split(",") if s and not s.startswith("random")] == want, r["text"]
        assert have["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [have["n_assign"], have["n_access"], have["n_hex"]] == [sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex")]


def battery(token):
    """The sum of squared deviations, from the definitions."""
    name, alphabet = next((n, a) for n, a in secretscan.ENCODINGS if set(token) <= set(a))
    n, size, v = len(token), len(alphabet), [alphabet.index(c) for c in token]
    chi = sum((v.count(i) - n / size) ** 2 / (n / size) for i in range(size))
    high = [2 * x >= size for x in v]
    a, b = sum(high), n - sum(high)
    if not a or not b:
        return name, None
    runs, mean = 1 + sum(x != y for x, y in zip(high, high[1:])), 1 + 2 * a * b / n
    serial = (n * sum(x * y for x, y in zip(v, v[1:] + v[:1])) - sum(v) ** 2) / (n * sum(x * x for x in v) - sum(v) ** 2)
    deviations = (chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n), (runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)), (serial + 1 / (n - 1)) / math.sqrt(n * n / ((n - 1) ** 2 * (n - 2)))
    return name, sum(d * d for d in deviations)


def test_battery_from_its_definitions(spark):
    rng = random.Random(6)
    tokens = ["".join(rng.choices(a, k=rng.randrange(16, 90))) for _, a in secretscan.ENCODINGS for _ in range(6)] + ["abcdefghijklmnopqrstuvwxyz", "a" * 20, "ab" * 20, "internationalization", "0123456789" * 4]
    docs = spark.createDataFrame(list(enumerate(f"x {t} y" for t in tokens)), "doc_id long, text string")
    got = {r["token"]: r for r in secretscan.measured(secretscan.matches(docs)).where("kind = 3").collect()}
    for t in tokens:
        name, want = battery(t)
        r = got[t]
        assert r["encoding"] == name and r["pairs"] == sum(math.comb(t.count(c), 2) for c in set(t))
        assert (r["battery"] is None) == (want is None) and (want is None or math.isclose(r["battery"], want, rel_tol=1e-9))


def corpus(keys, seed):
    rng = random.Random(seed)
    common = "the of and to in that is was for with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    words = lambda n: " ".join(rng.choice(common) for _ in range(n))
    compounds = ["".join(w.capitalize() for w in rng.choices(common, k=6)) for _ in range(60)] + ["-".join(rng.choices(common, k=5)) for _ in range(60)] + ["/".join(rng.choices(common, k=6)) for _ in range(60)]
    compounds = [c for c in compounds if len(c) >= 16]
    docs = [f"{words(30)} {c} {words(30)}" for c in compounds]
    docs += [f"{words(20)} {k} {words(20)}" for k in keys]
    rng.shuffle(docs)
    return list(enumerate(docs)), compounds


@pytest.mark.parametrize("alphabet", [string.ascii_letters + string.digits, string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "+/"])
def test_random_keys_are_found_and_words_are_not(spark, alphabet):
    rng = random.Random(7)
    keys = ["".join(rng.choices(alphabet, k=64)) for _ in range(40)]
    docs, compounds = corpus(keys, 8)
    docs += [(10**6 + i, docs[0][1]) for i in range(200)]  # copies are one test
    found = {r["value"] for r in secretscan.spans(spark.createDataFrame(docs, "doc_id long, text string")).where("kind = 3").collect()}
    assert len(found & set(keys)) >= 36 and not found & set(compounds)


def test_without_ordinary_words(spark):
    docs = spark.createDataFrame([(1, "x" * 40), (2, "")], "doc_id long, text string")
    assert [r["spans"] for r in secretscan.digest(secretscan.spans(docs)).collect()] == ["", ""]
