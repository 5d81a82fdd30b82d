"""Stems by the published rules, and searches by stem."""

import math
import re

import pytest

from lorekeep.functions.stem import stem
from lorekeep.operators import index, search

#: The examples of the published rules, with what all steps together make of them.
PUBLISHED = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun
activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil""".split()


@pytest.mark.parametrize(("word", "expected"), list(zip(PUBLISHED[::2], PUBLISHED[1::2], strict=True)))
def test_published_examples(word, expected):
    assert stem(word) == expected


def test_other_words_stay():
    for word in ("", "a", "is", "été", "x_ing", "mp3s", "東京", "tests2"):
        assert stem(word) == word


def other_stem(word):
    """Written apart from the library's: one pass over a list of letters, conditions as regular expressions on the word itself."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    c, v = "(?:[^aeiouy]|(?:(?<=[aeiou])|^)y)", "(?:[aeiou]|(?<![aeiou])(?<!^)y)"
    m = lambda s: len(re.findall(f"{v}+{c}", s))
    has, o = lambda s: re.search(v, s), lambda s: re.search(f"{c}{v}[^aeiouwxy]$", s)
    word = re.sub("sses$", "ss", word) if word.endswith("sses") else re.sub("ies$", "i", word) if word.endswith("ies") else re.sub("(?<!s)s$", "", word)
    if word.endswith("eed"):
        word = word[:-1] if m(word[:-3]) else word
    elif (e := re.search("(ed|ing)$", word)) and has(word[: e.start()]):
        word = word[: e.start()]
        if re.search("(at|bl|iz)$", word):
            word += "e"
        elif re.search(r"([^aeioulsz])\1$", word) and not re.search("yy$", word):
            word = word[:-1]
        elif m(word) == 1 and o(word):
            word += "e"
    if word.endswith("y") and has(word[:-1]):
        word = word[:-1] + "i"
    two = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
    three = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
    for rules in (two, three):
        for rule in sorted(rules.split(), key=lambda r: -len(r.partition(":")[0])):
            end, _, put = rule.partition(":")
            if word.endswith(end):
                word = word[: -len(end)] + put if m(word[: -len(end)]) else word
                break
    for end in "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic ou".split():
        if word.endswith(end):
            rest = word[: -len(end)]
            word = rest if m(rest) > 1 and (end != "ion" or rest[-1:] in "st") else word
            break
    if word.endswith("e") and (m(word[:-1]) > 1 or (m(word[:-1]) == 1 and not o(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and m(word[:-1]) > 1 else word


def test_against_another_implementation(spark, sf):
    text = " ".join(r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    words = set(re.findall("[a-z]+", text.lower())) | {w + e for w in PUBLISHED for e in ("ing", "ed", "s", "ly", "ational", "ness", "y")}
    assert len(words) > 1000
    assert {w: stem(w) for w in words} == {w: other_stem(w) for w in words}


def test_search_by_stem(spark, tmp_path):
    rows = [(f"id{i}", "p", title, body, tags) for i, (title, body, tags) in enumerate([
        ("connected caches", "the cache was connecting", ["connection"]), ("Connection", "no caching", None), ("retry", "nothing of it", ["cached"]), (None, "connects", []), ("x", None, ["y"])])]
    observations = spark.createDataFrame(rows, "id string, project string, title string, body string, tags array<string>")
    made = index.SearchIndex(spark, str(tmp_path), stemmed=True).refresh(observations)
    found = {r["id"]: r["score"] for r in search.indexed_scores(made, "connect caching connecting").collect()}

    split = lambda t: [other_stem(w) for w in re.findall(r"\w+", (t or "").lower())]
    docs = {i: (split(title), split(body), split(" ".join(tags or []))) for i, _, title, body, tags in rows}
    length, expected = {i: sum(map(len, d)) for i, d in docs.items()}, {}
    average = sum(length.values()) / len(docs)
    for term in {"connect", "cach"}:
        df = sum(any(term in part for part in d) for d in docs.values())
        for i, d in docs.items():
            tf = sum(w * part.count(term) for w, part in zip((10, 1, 5), d, strict=True))
            if tf:
                expected[i] = expected.get(i, 0) + max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[i] / average))
    assert found.keys() == expected.keys() and all(math.isclose(found[i], expected[i], rel_tol=1e-9) for i in found)
    assert index.SearchIndex(spark, str(tmp_path)).state["stemmed"]
