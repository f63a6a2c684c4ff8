import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from thalweg.llm import pii


def brute(text):
    def luhn(d):
        t = 0
        for i, c in enumerate(d[::-1]):
            v = int(c) * (2 if i % 2 else 1)
            t += v - 9 if v > 9 else v
        return t % 10 == 0

    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    cards = [(m, re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    found["card"] = [m.span() for m, d in cards if 13 <= len(d) <= 19 and luhn(d)]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in found[k])


ODD = [
    (1, None), (2, ""), (None, "a@b.co"), (3, "x@y@z.com @ a..b@c-.d 🙂 é@b.c"), (3, "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3"), (4, "4952935900253052 4952-9359 0025 3052 49529359002530521 +1 (974) 555-3436 +1.2 +12345678901234567"),
    (5, "word " * 40_000 + "a.b@c.de"), (6, "9" * 5000 + "." * 10 + "@" * 3000), (7, "a" * 3000 + "@" + "b" * 3000 + "." + "c" * 3000),
]


def test_plain_forms_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    given = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).withColumn("spans", F.lit(0)).withColumn("n_ip", F.lit("clash"))
    want = []
    for r in given.select("doc_id", "text").collect():
        found = brute(r.text or "")
        want.append((r.doc_id, *(len(found[k]) for k in pii.KINDS), hashlib.sha256(listed(found).encode()).hexdigest()))
    got = pii.personal_data(given).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by = {(r.doc_id, r.base_sha256): r for r in got}
    assert all(r.base_sha256 != hashlib.sha256(b"").hexdigest() or not r.n_email for r in by.values())


def test_random_texts():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice("ab1.9@+-_ ()é0 ") for _ in range(rng.randrange(60)))
        assert pii.find(text)[0] == brute(text), text


@pytest.mark.parametrize(
    "before, hidden, kind",
    [
        ("mail ", "jоhn.dое@ехample.com", "email"),
        ("🙂 ", "john [at] example (dot) com", "email"),
        ("to ", "ann at example dot co dot uk", "email"),
        ("é ", "j.doe@exa​mple.com", "email"),
        ("call ", "plus four four two zero seven nine four six oh nine five eight", "phone"),
        ("", "４９５２９３５９００２５３０５２", "card"),
        ("card: ", "four nine five two nine three five nine zero zero two five three zero five two", "card"),
        ("ip ", "97 dot 51 dot 17 dot 173", "ip"),
        ("ip ", "٩٧.٥١.١٧.١٧٣", "ip"),
    ],
)
def test_disguises(before, hidden, kind):
    text = before + hidden + " ."
    base, everything = pii.find(text)
    assert not base[kind]
    assert everything[kind] == [(len(before), len(before) + len(hidden))]


@pytest.mark.parametrize("text", ["look at the dot matrix", "one two three go", "a café at nine", "à être où ß ½ ²", "meet at noon. dot", "[at] home"])
def test_ordinary_text_is_left_alone(text):
    assert not any(pii.find(text)[1].values())


def test_base_spans_stay(spark):
    text = "a@b.co and c [at] d [dot] org, 1.2.3.4"
    base, everything = pii.find(text)
    assert everything["email"] == base["email"] + [(11, 29)] and everything["ip"] == base["ip"]
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("text", ["9" * 150_000 + " dot com", " " * 150_000 + "[at]", "a" * 150_000 + " dot com", "one " * 30_000 + "two", "a dot " * 20_000 + "com", "@" * 150_000, "+1 (" * 40_000])
def test_long_runs_take_no_long_time(text):
    import time

    start = time.process_time()
    pii.find(text)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(
    "hidden",
    [
        "jane [at] example dot com", "jane@example dot com", "jane at example [dot] com", "jane (at) mail.example dot com", "jane@mail dot example [dot] org",
        "anna at firma dot pl", "anna at firma dot ru", "anna at firma dot se", "anna at firma dot nz", "Anna At Firma Dot Online", "jane@intranet dot corp", "jane at host [dot] internal",
        "j dot a dot doe [at] example dot com", "j [dot] doe at example dot com", "a dot b dot c dot d dot e dot f dot g dot h dot i at example dot com", "a at b dot c dot d dot e dot f dot g dot h dot i dot j dot com",
        "jane at mail dot firma.pl",
        "jane at example.com", "jane.doe at mail.example.co.uk", "jane@example[.]com", "jane (a) example (dot) com", "jane{@}example.com", "jane  at  example  dot  com",
        "jane [@] example [.] com", "jane at example.com", "jane\tat\texample.org",
    ],
)
def test_mixed_and_long_addresses(hidden):
    for after in (" .", "", ", and more", " today"):
        base, everything = pii.find("write to: " + hidden + after)
        assert not base["email"] and everything["email"] == [(10, 10 + len(hidden))]


@pytest.mark.parametrize("text", ["look at example.com today", "he pointed at that dot matrix", "met at noon at the dot", "@home dot", "at dot com", "see [dot] com"])
def test_speech_is_no_address(text):
    assert not any(pii.find(text)[1].values())


def test_speech_after_an_address_is_left_out():
    assert pii.find("jane@example dot com dot thanks")[1]["email"] == [(0, 20)]
    assert pii.find("jane@example.com dot your eyes")[1]["email"] == [(0, 16)]
    assert pii.find("97 dot 51 [dot] 17.173")[1]["ip"] == [(0, 22)]


@pytest.mark.parametrize("text", ["a at b dot " * 20_000, "a at " * 30_000 + "b dot com", "a@" + "b dot " * 30_000 + "com", "a dot " * 30_000 + "b at c dot com", "a at b dot c" * 20_000])
def test_many_signs_take_no_long_time(text):
    import time

    start = time.process_time()
    pii.find(text)
    assert time.process_time() - start < 10


@pytest.mark.parametrize(
    "hidden, kind",
    [
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("one nine two.one six eight.zero.one", "ip"),
        ("one nine two [dot] one six eight (.) zero dot one", "ip"),
        ("192[.]168[.]0[.]1", "ip"),
        ("192  dot  168 dot 0 dot 1", "ip"),
        ("plus one double five five one two triple three four", "phone"),
    ],
)
def test_octets_in_words_and_brackets(hidden, kind):
    base, everything = pii.find("see " + hidden + ", please")
    assert not base[kind] and everything[kind] == [(4, 4 + len(hidden))]


@pytest.mark.parametrize("text", ["look at example.com", "Visit us at www.example.org now", "option (a) example.com", "one two.three", "one.two", "double or triple", "I was at a. Come at b.c", "at example.com", "seen at. com", "[.] and [@]"])
def test_more_speech_is_no_address(text):
    assert not any(pii.find(text)[1].values())


@pytest.mark.parametrize("text", ["one." * 40_000, "one " * 40_000 + ".", "double " * 40_000 + "one", "a at b." * 30_000, "x [.] " * 30_000, "(a) " * 40_000 + "b [.] c", "one" + " " * 100_000 + "two"])
def test_long_runs_of_new_forms_take_no_long_time(text):
    import time

    start = time.process_time()
    pii.find(text)
    assert time.process_time() - start < 10
