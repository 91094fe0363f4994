"""Personal data: plain patterns against the patterns as given, disguises by hand."""

import hashlib
import random
import re

import pytest

from rangeledger.llm import pii

# The patterns of the contract.
GIVEN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def given_spans(text):
    out = []
    for kind, pattern in enumerate(GIVEN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def random_texts(n, seed=7):
    rnd = random.Random(seed)
    parts = ["1", "2", "0", "9", ".", ".", "-", " ", " ", "+", "@", "a", "b", "%", "(", ")", "4111111111111111", "é", "10.0.0.1", "x@y.z", " at ", " dot ", "one ", "[at]", "о", "​", "O", "l"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_plain_spans():
    for text in random_texts(20_000):
        assert pii.plain_spans(text) == given_spans(text), text


def test_added_spans_stand_beside_plain_ones():
    for text in random_texts(5_000, 8):
        plain, added = pii.find_spans(text)
        assert plain == given_spans(text) and not set(plain) & set(added)
        assert all(0 <= s < e <= len(text) for s, _, e in added) and added == sorted(set(added))


DISGUISED = [
    ("email", "jane [at] example [dot] com"), ("email", "jane.doe(at)example.com"), ("email", "jane AT example DOT com"), ("email", "jane dot doe at mail dot example dot com"),
    ("email", "аdmin@exаmple.com"), ("email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "jane&#64;example&#46;com"), ("email", "jane%40example.com"),
    ("email", "jane_at_example_dot_com"), ("email", "jane-at-example-dot-com"), ("email", "jane@exa​mple.com"), ("email", "jane{at}example{dot}com"), ("email", "jane @ example . com"),
    ("email", "juan arroba ejemplo punto com"), ("email", "jane@example dot com"), ("email", "j99 at example.com"), ("email", "jane [ at ] exa­mple [.] com"),
    ("card", "four one one one one one one one one one one one one one one one"), ("card", "4I11 1111 1111 1111"), ("card", "41l1-111l-1111-1111"), ("card", "４１１１ １１１１ １１１１ １１１１"),
    ("card", "four triple one double one double one double one double one double one double one"), ("card", "4111-1111-1111-one one one one"), ("card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("card", "cuatro uno uno uno uno uno uno uno uno uno uno uno uno uno uno uno"), ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"), ("card", "4111 1111 1111 1111"),
    ("phone", "plus one nine eight eight five five five two four eight five"), ("phone", "+１ (988) 555-2485"), ("phone", "+1 988 five five five two four eight five"), ("phone", "+1 (988) 555-2O85"), ("phone", "+1–988–555–2485"),
    ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "ten dot zero dot zero dot one"), ("ip", "two hundred fifty five dot ten dot twenty one dot one hundred two"), ("ip", "192[.]168[.]0[.]1"), ("ip", "192 dot 168 dot 0 dot 1"), ("ip", "1O.0.0.l"),
]


@pytest.mark.parametrize(("kind", "words"), DISGUISED)
@pytest.mark.parametrize(("before", "after"), [("", ""), ("Café \U0001f600, words: ", " and so on."), ("(", ")"), ("bob@x.org, ", "\nten thousand and one at last")])
def test_disguises(kind, words, before, after):
    text = before + words + after
    _, added = pii.find_spans(text)
    assert (len(before), pii.KINDS.index(kind), len(before) + len(words)) in added, [(pii.KINDS[k], text[s:e]) for s, k, e in added]


CLEAN = [
    "Look at example.com for more.", "They met at noon. The dot com era was over at last.", "Follow us @ example.com today", "one two three four five six seven", "Die Null stand am Anfang, eins und zwei folgten.",
    "He arrived at 10.30 on May 5. One or two came.", "version 1.2.3 at build 4", "Un deux trois, nous irons au bois", "see look-at-me.com now", "pages 1914–1918 and 10 000 000", "Il a 10 ou 11 ans", "300.1.1.1 and 4111 1111 1111 1112",
    "au point contact", "a[i] = b[j] (at line 5)", "Привет, читайте нас", "write to us (dot your letters)", "x @ y", "&amp; &#64; %40",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert pii.find_spans(text) == ([], [])


def test_an_address_is_extended_but_plain_ones_stay():
    text = "bob@x.co[dot]uk"
    assert pii.find_spans(text) == ([(0, 0, 8)], [(0, 0, 15)])
    assert pii.find_spans("au point contact@exemple.fr") == ([(9, 0, 27)], [])
    assert pii.masked("to bob@x.co[dot]uk, +1 (988) 555-2485", [s for part in pii.find_spans("to bob@x.co[dot]uk, +1 (988) 555-2485") for s in part]) == "to [EMAIL], [PHONE]"


def test_long_runs_take_time_in_proportion():
    for text in ("1" * 200_000, "a." * 100_000 + "@", "one two " * 30_000, " at a." * 30_000, "+1" * 60_000, "a@" * 60_000, "1 " * 60_000 + "+ " * 99, "Il1 " * 30_000, "[ \t" * 30_000, " " * 100_000 + "[", " at" * 50_000 + "@"):
        pii.find_spans(text)


def test_documents(spark, tricky, empty):
    more = spark.createDataFrame([(99, "x" * 50_000 + " jane [at] example [dot] com " + "\U0001f600 y" * 9_000 + " 10.0.0.1"), (98, None), (None, "bob@x.org")], "doc_id long, text string")
    docs = tricky.select("doc_id", "text").unionByName(more)
    got = pii.pii_digest(pii.find_pii(docs)).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for i, text in rows:
        plain, added = given_spans(text), pii.find_spans(text)[1]
        write = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((str(i), *(sum(k == n for _, k, _ in plain) for n in range(4)), hashlib.sha256(write(plain).encode()).hexdigest(), write(plain + added), len(added)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert got[0].__fields__ == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
    assert pii.pii_digest(pii.find_pii(empty)).count() == 0


def test_masked_documents_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "mail jane at example dot com", 1, 2, 3), (2, None, 1, 2, 3)], "doc_id long, text string, pii int, masked_text int, spans int")
    got = {r["doc_id"]: r["masked_text"] for r in pii.find_pii(docs, mask=True).collect()}
    assert got == {1: "mail [EMAIL]", 2: ""}
