"""Entropy spans of the secret scan against a brute-force scan, and on planted keys."""

import collections
import math
import random
import re
import string

import pytest

from nearname.llm import secrets

ALNUM = string.ascii_letters + string.digits
WORDS = re.compile(r"0123456789|abcdefghij|example|placeholder|x{6,}", re.I)


def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in collections.Counter(s).values())


def brute(text):
    """(kind, start, end) of the runs with a part that has the form and a window of enough entropy."""
    found = []
    for kind, pattern, bits in (
        ("entropy_hex", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{16,}(?![0-9A-Za-z])", 2.8),
        ("entropy_mixed", r"(?<![0-9A-Za-z+/_-])[0-9A-Za-z+/_-]{16,}", 3.3),
        ("entropy_letters", r"(?<![0-9A-Za-z])[A-Za-z]{16,}(?![0-9A-Za-z])", 3.3),
    ):
        for m in re.finditer(pattern, text):
            for part in WORDS.split(m.group()):
                if len(part) < 16:
                    continue
                if kind == "entropy_letters":
                    upper = sum(c.isupper() for c in part)
                    changes = sum(a.isupper() != b.isupper() for a, b in zip(part, part[1:]))
                    fits = 0 < upper < len(part) and changes >= (len(part) - 1) * secrets.CASES and upper > len(part) * secrets.UPPER
                else:
                    fits = any(c.isdigit() for c in part) and any(c.isalpha() for c in part)
                if fits and any(entropy(part[i : i + 16]) >= bits - 1e-12 for i in range(len(part) - 15)):
                    found.append((kind, m.start(), m.end()))
                    break
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def scanned(spark, texts):
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [[(s["kind"], s["start"], s["end"]) for s in r["secrets"] if s["kind"].startswith("entropy")] for r in sorted(rows)]


def test_spans_equal_brute_force(spark):
    rng = random.Random(9)
    alphabets = ["ab1", "0123456789abcdef", ALNUM, string.ascii_letters, "aB+/_-9", string.digits]
    bits = ["example", "0123456789", "abcdefghij", "xxxxxxxx", " ", "é", "/", "thisIsAVeryLongVariableName"]
    texts = []
    for _ in range(300):
        parts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 40))) if rng.random() < 0.6 else rng.choice(bits) for _ in range(8)]
        texts.append("".join(parts))
    want = [brute(t) for t in texts]
    assert {k for spans in want for k, _, _ in spans} == {"entropy_hex", "entropy_mixed", "entropy_letters"}
    assert scanned(spark, texts) == want


@pytest.mark.parametrize("alphabet", ["0123456789abcdef", ALNUM, string.ascii_letters])
def test_planted_keys_of_twenty_characters(spark, alphabet):
    rng = random.Random(4)
    texts = [f"see https://h/example/{''.join(rng.choices(alphabet, k=20))} now" for _ in range(400)]
    assert sum(bool(spans) for spans in scanned(spark, texts)) >= 0.95 * len(texts)


def test_names_and_words_are_no_secrets(spark):
    texts = ["getElementsByClassName AbstractSingletonProxyFactoryBean", "Geschwindigkeitsbegrenzung incomprehensibilities",
             "4242424242424242 0123456789abcdef", "EXAMPLEEXAMPLE12 placeholder-xxxxxxxxxx"]
    assert scanned(spark, texts) == [[]] * 4


def test_long_runs_and_stretch_borders(spark):
    rng = random.Random(6)
    key = "".join(rng.choices(ALNUM, k=16))
    # The only rich window lies across, just before and just behind the border of two stretches.
    texts = ["a1" * 500 + "a" * n + key + "1a" * 700 for n in range(0, 40, 3)] + ["a1" * 50_000]
    assert scanned(spark, texts) == [[("entropy_mixed", 0, len(t))] for t in texts[:-1]] + [[]]


def test_clashing_name(spark):
    found = secrets.scan(spark.createDataFrame([("secret=abcdef0", "b")], "text string, Secrets string"))
    assert found.columns == ["text", "Secrets", "secrets_"]
    row = found.first()
    assert row["Secrets"] == "b" and [s["kind"] for s in row["secrets_"]] == ["assign"]
