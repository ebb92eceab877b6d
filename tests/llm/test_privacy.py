from __future__ import annotations

import re
from hashlib import sha256

import pytest

from lakeseed.llm import privacy as p


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


TEXTS = [
    "mail a.b+c@x-y.example.com, and b@c or d@e.f.g@h.i",
    "a@b.com_x@y.z %@%.% .a@b..c x@y.z.@q.r",
    "1.2.3.4 256.1.1.1 001.002.003.255 1.2.3.4.5.6.7.8 9.9.9 0000000000256.1.1.1",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111110000000 4111  1111",
    "4111 1111 1111 1111 2 x 0-0-0-0 0 0 0 0 0 0 0 0",
    "phone +1 (017) 555-7713 +12 +1.2.3.4.5.6.7.8.9 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "😀 é x@y.zz 😀 +49 30 1234567 ",
    "no data here",
    "",
    None,
    "9" * 30_000 + " " + "1 " * 20_000 + "a." * 20_000 + "@b" + ".c" * 20_000 + "-" * 9,
]


@pytest.fixture(scope="module")
def found(documents):
    return {r.doc_id: r for r in p.judged(documents(list(enumerate(TEXTS)), clash=True)).collect()}


@pytest.mark.parametrize("doc_id", range(len(TEXTS)))
def test_base_like_plain(found, doc_id):
    spans = plain_base(TEXTS[doc_id])
    row = found[doc_id]
    assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
    written = ",".join(f"{p.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    assert row.base_sha256 == sha256(written.encode()).hexdigest()
    # In so few texts a word that stands beside an entity is nowhere else.
    assert ",".join(span for span in row.spans.split(",") if not span.startswith("term")) == written


NAMES = ["the", "office", "called", "about", "some", "things", "today"]


def corpus():
    rows = []
    for i in range(60):
        rows.append((i, f"dear all a report {i} from where the office called about some things today and number{'abcdefghij'[i % 10]} more words", "en", "a"))
    for i in range(5):
        rows.append((100 + i, f"Dear {'abcde'[i] * 5} Zaphod from the office called about boss@example.com today {'fghij'[i] * 6}", "en", "a"))
    # Copies of one surrounding are one text, and two words lie between.
    rows += [(200 + i, "Trillian wrote things to ford@example.org today", "en", "a") for i in range(9)]
    return rows


def test_terms_that_disclose_an_entity(documents):
    rows = corpus()
    found = {r.doc_id: r.spans for r in p.judged(documents(rows, clash=True)).collect()}
    for i in range(5):
        at = rows[60 + i][1].index("Zaphod")
        assert f"term:{at}:{at + 6}" in found[100 + i].split(",")
        assert found[100 + i].count("term") == 1
    assert all(not found[i] for i in range(60))
    assert all("term" not in found[200 + i] for i in range(9))


def plain_pairs(rows):
    """The disclosing pairs, from plain counts of different texts, for entities that are addresses."""
    texts = sorted({t for _, t, *_ in rows if t is not None})
    address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    parts = [[w.lower() for w in re.findall(rf"{address}|[^\W\d_]{{4,}}", t)] for t in texts]
    known = sorted({w for words in parts for w in words if "@" in w})
    held = {e: frozenset(n for n, words in enumerate(parts) if e in words) for e in known}
    out = set()
    for e in known:
        kin = {o for o in known if held[o] == held[e]}
        for term in {w for n in held[e] for w in parts[n] if "@" not in w}:
            n_t = sum(term in words for words in parts)
            both = [parts[n] for n in held[e] if term in parts[n]]
            seen = 0
            for words in both:
                best = p.LEAST
                for i, w in enumerate(words):
                    for step in (1, -1):
                        j, d = i + step, 0
                        while w == term and 0 <= j < len(words) and "@" not in words[j]:
                            j, d = j + step, d + 1
                        if w == term and 0 <= j < len(words) and words[j] in kin:
                            best = max(best, 1000 * p.NEAR // (p.NEAR + d))
                seen += best
            chance = len(both) / n_t * (seen / (seen + p.PRIOR))
            if chance >= p.CHANCE and chance * len(texts) > len(held[e]) and len(held[e]) < len(texts):
                out.add((f"0:{e}", term))
    return out


def test_strength_like_plain(documents):
    from random import Random

    rng = Random(9)
    words = ["Arthur", "Fenchurch", "tea", "towel", "planet", "guide", "panic", "Dent's", "élan", "a@b.cc", "x@y.zz", "q@r.ss", "home"]
    rows = corpus() + [(500 + n, " ".join(rng.choices(words, k=rng.randint(1, 14))), "en", "a") for n in range(80)]
    rows += [(700 + n, f"{rng.choice(words)} Slartibartfast {'far ' * n} fjord of f@jo.rd {n}", "en", "a") for n in range(12)]
    frame = documents(rows)
    pairs = {(r.entity, r.term) for r in p.disclosing(frame, p.scanned(frame)).collect()}
    assert pairs == plain_pairs(rows)
    assert ("0:boss@example.com", "zaphod") in pairs and ("0:f@jo.rd", "slartibartfast") in pairs


def test_sanitised(documents):
    texts = {r.doc_id: r.text for r in p.sanitised(documents(corpus() + [(300, "😀 1.2.3.4 é +1 234 567 890", "en", "a")])).collect()}
    assert texts[100] == "Dear aaaaa  from the office called about [EMAIL] today ffffff"
    assert texts[300] == "😀 [IP] é [PHONE]"
    assert 0 not in texts


def rare_entities(n):
    """Texts of common words; entities in one or two texts each, beside a name or far from it."""
    from random import Random

    rng, words = Random(5), [a + b for a in ("bal", "cor", "dim", "fen", "gol", "hus") for b in ("tana", "reki", "silo", "mupa", "vedo")]
    rows = [(i, " ".join(rng.choices(words, k=60)), "en", "a") for i in range(n)]
    far = " ".join(words * 2)
    rows += [(10_000, f"{far} of Beeblebrox, 4111 1111 1111 1111 {far}", "en", "a"), (10_001, f"Prosser {far} 5500 0000 0000 0004 {far}", "en", "a")]
    rows += [(10_010 + i, f"{far} Slartibartfast goltana of fj@example.com {i}", "en", "a") for i in range(2)]
    # A name that as many texts without the address hold tells little of it; copies of them count once.
    rows += [(10_020 + i, f"{far} of Marvin marvin@example.com", "en", "a") for i in range(50)]
    rows += [(10_080 + i, f"Marvin {far} {i}", "en", "a") for i in range(3)]
    return rows


@pytest.mark.parametrize("n", [60, 1200])
def test_the_same_terms_pass_in_small_and_large_tables(documents, n):
    frame = documents(rare_entities(n), clash=True)
    pairs = {(r.entity, r.term) for r in p.disclosing(frame, p.scanned(frame)).collect()}
    assert pairs == {("2:4111111111111111", "beeblebrox"), ("0:fj@example.com", "slartibartfast")}
    found = {r.doc_id: r.spans.split(",") for r in p.judged(frame).collect()}
    assert sum("term" in s for s in found[10_000]) == 1 and "term" not in str(found[10_001])
    assert all("term" in str(found[10_010 + i]) for i in range(2))
    assert all("term" not in s for i in range(50) for s in found[10_020 + i])


def test_texts_of_many_entities_take_linear_time(documents):
    from time import perf_counter

    long = " ".join(f"+1 234 {n:06d} call" for n in range(60_000))
    started = perf_counter()
    row = p.judged(documents([(1, long, "en", "a"), (2, "call home", "en", "a")])).where("doc_id = 1").first()
    assert row.n_phone == 60_000 and perf_counter() - started < 30
    spans = [span.split(":") for span in row.spans.split(",")]
    assert all(long[int(a) : int(b)] == f"+1 234 {n:06d}" for n, (_, a, b) in enumerate(s for s in spans if s[0] == "phone"))


def test_odd_rows_and_empty_table(documents, odd_rows):
    assert p.judged(documents(odd_rows, clash=True)).count() == len(odd_rows)
    assert p.judged(documents([])).count() == 0


def test_plan_is_native(documents):
    plan = p.judged(documents(corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
