import random
import re
from collections import Counter

import duckdb
import pytest

from siltstone.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def fits(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return sorted(((m.start(), m.end(), k) for k, p in BASE.items() for m in p.finditer(text) if fits(k, m.group())), key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("aZ@@..1+- ()2559é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    for _ in range(3000):
        text = "".join(rng.choice("0123456789 -") for _ in range(rng.randint(10, 60)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("to john dot doe at example dot co dot uk!", "email", "john dot doe at example dot co dot uk"),
        ("é us\u0435r@ex\u0430mple.com", "email", "us\u0435r@ex\u0430mple.com"),
        ("\uff4a\uff4f\uff20\uff45\uff58\uff0e\uff43\uff4f\uff4d", "email", "\uff4a\uff4f\uff20\uff45\uff58\uff0e\uff43\uff4f\uff4d"),
        ("jo\u200bhn@exa\u200bmple.com", "email", "jo\u200bhn@exa\u200bmple.com"),
        ("on 10[.]0[.]0[.]1 today", "ip", "10[.]0[.]0[.]1"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("call plus four nine three zero one two three four five", "phone", "plus four nine three zero one two three four five"),
        ("pay four five three two zero one five one one two eight three zero three six six", "card", "four five three two zero one five one one two eight three zero three six six"),
        ("john at example.com", "email", "john at example.com"),
        ("to john&#64;example&#x2E;com now", "email", "john&#64;example&#x2E;com"),
        ("to johnATexampleDOTcom now", "email", "johnATexampleDOTcom"),
        ("write to john at example.de now", "email", "john at example.de"),
        ("ask j.doe at example.it today", "email", "j.doe at example.it"),
        ("john at example dot it", "email", "john at example dot it"),
        ("please mail john at example.com or call", "email", "john at example.com"),
        ("see john_at_example_dot_com.", "email", "john_at_example_dot_com"),
        ("john -at- example -dot- com", "email", "john -at- example -dot- com"),
        ("say j o h n @ example . com", "email", "j o h n @ example . com"),
        ("ask jo.h2 @ example.org.", "email", "jo.h2 @ example.org"),
        ("at 192.168.one.one now", "ip", "192.168.one.one"),
        ("at 192 dot 168 dot 1 dot 1 now", "ip", "192 dot 168 dot 1 dot 1"),
        ("plus 49 three zero one two three four five six seven", "phone", "plus 49 three zero one two three four five six seven"),
        ("\u0664\u0665\u0663\u0662\u0660\u0661\u0665\u0661\u0661\u0662\u0668\u0663\u0660\u0663\u0666\u0666", "card", None),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source):
    base, added = pii.analyse(text)
    spans = [(text[s:e], k) for s, e, k in added]
    assert (source or text, kind) in spans
    assert base == brute(text)


@pytest.mark.parametrize("text", ["", "look at example.com", "meet me at the dot", "one two three go", "un deux trois", "a [at] b", "caf\u00e9 \u00bd \u2013 12", "nine to five at work dot", "meeting (at) noon [dot] then", "we met at home. It was late", "shop at amazon.com today", "lists: 1. 2. 3. 4", "follow @bar or @ home now", "look_at_me and at_dot_then", "one. two. three.", "v1.2.3.400 and 999.1.1.1",
    "contact us at office.de", "look at this dot it is", "sleep at night.to rest", "come at dinner.it was", "price at 3.de", "eat at joes.me too", "today at five.it", "They sleep at night.to rest", "at 10.30 at joes.me", "a &lt; b &#64; c", "thATis DOTted"])
def test_clean_texts_stay_clean(text):
    assert pii.analyse(text)[1] == []


@pytest.mark.parametrize(("text", "kind", "source"), [("call +49 30 one 234 567 now", "phone", "+49 30 one 234 567"), ("pay 4532 0151 one 283 0366", "card", "4532 0151 one 283 0366"), ("rufe +49 30 eins 234 567", "phone", "+49 30 eins 234 567")])
def test_one_spelled_digit_among_digits(text, kind, source):
    assert (source, kind) in [(text[s:e], k) for s, e, k in pii.analyse(text)[1]]


SPELLED = "zero one two three four five six seven eight nine".split()


def luhn_card(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(15))
    return next(digits + c for c in "0123456789" if fits("card", digits + c))


def disguises(rng):
    """(name, kind, text, offset of the identifier in it) of one identifier after each disguise."""
    local = "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    host, top = "".join(rng.choice("klmnopqrs") for _ in range(6)), rng.choice(["com", "org", "de", "fr"])
    ip = [str(rng.randint(1, 255)) for _ in range(4)]
    phone, card = "49" + "".join(rng.choice("0123456789") for _ in range(9)), luhn_card(rng)

    def say(digits):
        return " ".join(SPELLED[int(c)] for c in digits)

    wide = {c: chr(ord(c) + 0xFEE0) for c in map(chr, range(0x21, 0x7F))}
    mail = f"{local}@{host}.{top}"
    out = [
        ("brackets", "email", f"{local} [at] {host} (dot) {top}"), ("words", "email", f"{local} at {host} dot {top}"), ("underscores", "email", f"{local}_at_{host}_dot_{top}"),
        ("dashes", "email", f"{local} -at- {host} -dot- {top}"), ("spaced signs", "email", f"{local} @ {host} . {top}"), ("spaced letters", "email", f"{' '.join(local)} @ {host} . {top}"),
        ("look-alikes", "email", mail.replace("a", "\u0430", 1).replace("o", "\u043e", 1).replace("@", "\uff20", 1)), ("full width", "email", "".join(wide[c] for c in mail)),
        ("zero width", "email", f"{local[:2]}\u200b{local[2:]}@{host}\u2060.{top}"),
        ("bracketed dots", "ip", "[.]".join(ip)), ("spelled dots", "ip", " dot ".join(ip)), ("spelled digits", "ip", " dot ".join(map(say, ip))), ("some spelled", "ip", f"{ip[0]}.{ip[1]}.one.two"),
        ("spelled", "phone", "plus " + say(phone)), ("partly spelled", "phone", f"+49 {say(phone[2:5])} {phone[5:]}"), ("spelled plus", "phone", f"plus 49 {say(phone[2:])}"),
        ("spelled", "card", say(card)), ("full width", "card", "".join(wide[c] for c in card)),
    ]
    return [(n, k, x) for n, k, x in out]


def test_recall_and_precision_of_each_disguise():
    """One identifier of each kind planted in every document between two words: found at its place, and nothing else is."""
    rng = random.Random(11)
    texts = [t for (t,) in duckdb.connect().sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall() if t and len(t) < 4000]
    assert len(texts) > 150
    hits, planted, wrong, found = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        before = len(pii.analyse(text)[1])
        gaps = [m.start() for m in re.finditer(" ", text)]
        for name, kind, hidden in disguises(rng):
            at = rng.choice(gaps) if gaps else 0
            changed = f"{text[:at]} : {hidden} ; {text[at:]}"
            added = pii.analyse(changed)[1]
            start = at + 3
            planted[name, kind] += 1
            hits[name, kind] += (start, start + len(hidden), kind) in added
            found[name, kind] += len(added)
            wrong[name, kind] += max(0, len(added) - before - ((start, start + len(hidden), kind) in added))
    for case, n in planted.items():
        assert hits[case] >= 0.9 * n, (case, hits[case], n)
        assert wrong[case] <= 0.1 * found[case], (case, wrong[case], found[case])


def test_many_changed_spans_are_handled_in_order():
    text = "\uff11\uff10.0.0.1 " * 20_000 + "x " + "four five three two zero one five one one two eight three zero three six six; " * 500
    added = pii.analyse(text)[1]
    assert sum(k == "ip" for _, _, k in added) == 20_000 and sum(k == "card" for _, _, k in added) == 500
    assert all(a[1] <= b[0] for a, b in zip(added, added[1:]))


def test_long_runs_are_linear():
    pii.analyse("1" * 200_000 + " " + "a" * 200_000 + "." * 50_000 + "@" * 1000 + "1." * 50_000 + "+1" * 50_000 + "four " * 20_000 + "-" * 100_000 + " at a" + ".a" * 50_000 + " dot" * 20_000 + "j o h n " * 20_000 + " @ " * 20_000)


def test_query(spark, edge_docs, no_docs):
    docs = spark.createDataFrame([(1, "a@b.cd 1.2.3.4 +49 30 1234567"), (2, None), (2, None)], "doc_id long, text string").selectExpr("*", "1 as spans")
    rows = pii.find(docs).orderBy("doc_id").collect()
    assert rows[0].spans == "email:0:6,ip:7:14,phone:15:29" and (rows[0].n_email, rows[0].n_ip, rows[0].n_card, rows[0].n_phone) == (1, 1, 0, 1)
    assert len(rows) == 3 and rows[1].spans == ""
    assert pii.find(edge_docs).count() == edge_docs.count() and pii.find(no_docs).count() == 0
    assert pii.redact("x a@b.cd, j [at] k [dot] de") == "x <EMAIL>, <EMAIL>"
