import hashlib
import random
import re

from orrery.llm import pii as P


def luhn(d):
    s = 0
    for k, c in enumerate(d[::-1]):
        x = int(c) * (2 if k % 2 else 1)
        s += x if x < 10 else x - 9
    return s % 10 == 0


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


CASES = [
    "mail a.b+c@x-y.example.com, @bad b@c d@e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004", "+1 (555) 010-9999 +12 +44 20 7946 0958 +123456789012345678",
    "x@@y.com a@b..c a@b.c.", "é" * 9 + "joe@site.org", "1" * 500 + " " + "1 " * 300, "+1" * 50, "0.0.0.0000000000000000255",
]


def test_base_spans_against_brute_force(odd_texts):
    rng = random.Random(3)
    alphabet = ["a", "B", ".", "@", "-", "+", " ", "1", "23", "4111111111111111", "255", "256", "(", ")", "example.com", "\n", "é", "_", "%"]
    for t in CASES + odd_texts + ["".join(rng.choice(alphabet) for _ in range(25)) for _ in range(4000)]:
        assert P.joined(P.base_spans(t or "")) == brute(t), repr(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" * 100_000, "a@" * 100_000, "1 " * 200_000):
        P.base_spans(t)


def test_odd_texts_and_rows(make, odd_texts):
    texts = odd_texts + CASES
    got = P.find_pii(make(list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans.startswith(want) and r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in want.split(",") if x])


def test_empty_table(make):
    assert P.find_pii(make([])).count() == 0


def corpus():
    rows = [(k, f"ordinary words about weather and trains number {k}") for k in range(200)]
    rows += [(1000 + k, f"Ordinary Zanzibarian weather at jo@site.org brings trains {k}") for k in range(4)]
    return rows + [(2000, "mentions zanzibarian only once, ordinary weather, eve@else.org")]


def test_telling_terms_are_marked_and_ordinary_ones_are_not(make):
    rows = corpus()
    texts = dict(rows)
    for r in P.find_pii(make(rows)).collect():
        terms = [x for x in r.spans.split(",") if x.split(":")[0] in P.TERM_KINDS]
        words = {texts[r.doc_id][int(a) : int(b)].lower() for _, a, b in (x.split(":") for x in terms)}
        assert r.n_terms == len(terms)
        assert words == ({"zanzibarian", "brings"} if 1000 <= r.doc_id < 2000 else set())


def test_disclosure_is_pmi_over_ic(make):
    docs = make(corpus())
    scan = P.map_arrow(docs.select("doc_id", "text"), P._scan, P.SCAN)
    found = {r.t: r for r in P.disclosures(docs.select("doc_id", "text"), scan).collect()}
    import math

    ic = math.log2(205 / 4)
    assert abs(found[P._hash("zanzibarian")].disclosure - math.log2(4 * 205 / (4 * 5)) / ic) < 1e-9
    assert abs(found[P._hash("weather")].disclosure - math.log2(4 * 205 / (4 * 205)) / ic) < 1e-9


def test_sanitised_texts(make):
    docs = make(corpus())
    out = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert out[5] == dict(corpus())[5] and len(out) == 205
    assert "[EMAIL]" in out[1001] and "anzibar" not in out[1001] and "weather" in out[1001]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op10_pii(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(brute(texts[r.doc_id]).encode()).hexdigest()


def marked(docs, texts):
    out = {}
    for r in P.find_pii(docs).collect():
        terms = [x.split(":") for x in r.spans.split(",") if x.split(":")[0] in P.TERM_KINDS]
        out[r.doc_id] = [texts[r.doc_id][int(a) : int(b)] for _, a, b in terms]
    return out


def test_terms_far_from_the_entity_and_short_names_are_marked(make):
    filler = "ordinary words about weather and trains "
    rows = [(k, f"{filler}number {k}") for k in range(200)]
    rows += [(1000 + k, f"Kim went {filler * 20}\n\n{filler * (20 * (k % 2))} jo@site.org {filler * 30} Zanzibarian and Kim {filler * k}") for k in range(4)]
    got = marked(make(rows), dict(rows))
    for k in range(4):
        assert sorted(got[1000 + k]) == ["Kim", "Kim", "Zanzibarian", "went"]
    assert not any(got[k] for k in range(200))


def test_pruning_by_frequency_loses_no_pair(make):
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = []
    for k in range(400):
        mails = [f"m{j}@site.org" for j in {int(rng.paretovariate(0.5)) for _ in range(2)} if j < 40] if rng.random() < 0.6 else []
        own = [w for m in mails for w in words[len(m) * 3 + int(m[1:].split("@")[0]) :][:2] if rng.random() < 0.9]
        rows.append((k, " ".join(rng.sample(words, 5) + own + mails)))
    docs = make(rows).select("doc_id", "text")
    scan = P.staged(P.map_arrow(docs, P._scan, P.SCAN), "t")
    pairs = lambda least: {(r.e, r.t, r.joint) for r in P._disclosing(docs, scan, least)[0].collect() if r.disclosure >= 0.6}
    assert pairs(0.6) == pairs(0.0) != set()


def test_an_entity_of_one_document_has_its_telling_terms_marked(make):
    rows = [(k, f"ordinary words about weather and trains number {k}") for k in range(1000)]
    rows += [(2000, "ordinary weather, Quillfeather writes from eve@else.org about trains")]
    got = marked(make(rows), dict(rows))
    assert sorted(got.pop(2000)) == ["Quillfeather", "from", "writes"] and not any(got.values())


def test_thousands_of_zeros_in_an_address_do_not_stop_the_job():
    for part, good in (("0" * 5000, True), ("0" * 5000 + "255", True), ("0" * 5000 + "256", False), ("9" * 5000, False)):
        text = f"at {part}.1.1.1 here"
        assert ([k for *_, k in P.base_spans(text)] == ["ip"]) == good


def brute_terms(rows, generalise=P.GENERALISE, remove=P.REMOVE):
    """Term spans by (doc_id, text) from the formula alone, with dictionaries."""
    import math

    words, ents = [], []
    for _, t in rows:
        spans = P.base_spans(t or "")
        ents.append({f"{k}:{t[a:b].lower()}" for a, b, k in spans})
        words.append([(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")])
    df = {}
    for ws in words:
        for w in {w for *_, w in ws}:
            df[w] = df.get(w, 0) + 1
    df_e, joint, n = {}, {}, len(rows)
    free = []
    for (_, t), ws, es in zip(rows, words, ents):
        taken = [(a, b) for a, b, _ in P.base_spans(t or "")]
        free.append([(a, b, w) for a, b, w in ws if not any(a < y and x < b for x, y in taken)])
        for e in es:
            df_e[e] = df_e.get(e, 0) + 1
            for w in {w for *_, w in free[-1]}:
                joint[e, w] = joint.get((e, w), 0) + 1
    out = {}
    for (i, t), ws, es in zip(rows, free, ents):
        found = []
        for a, b, w in ws:
            best = 0.0
            for e in es:
                j = joint[e, w]
                more = P.SINGLE if j == 1 else 0
                ic = math.log2(n / df_e[e])
                best = max(best, math.log2(j * n / ((df_e[e] + more) * (df[w] + more))) / ic if ic > 0 else 0.0)
            if best >= generalise:
                found.append((int(best >= remove), a, b))
        out[i, t] = ",".join(f"{P.TERM_KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))
    return out


def test_term_spans_against_brute_force(make):
    rng = random.Random(15)
    words = [f"{a}{b}{c}" for a in "bdgk" for b in "aeiou" for c in ("ra", "li", "Mo", "é", "")]
    rows = []
    for k in range(500):
        mail = rng.choice(["", "", f"m{int(rng.paretovariate(0.7))}@site.org", f"10.0.0.{rng.randrange(9)}", f"x{k}@one.net y{k % 7}@two.net"])
        own = [f"Own{chr(97 + k % 26)}{chr(97 + k // 26)}"] if rng.random() < 0.5 else []
        rows.append((k, " ".join(rng.sample(words, rng.randrange(9)) + [mail] + own + rng.sample(words, 2))))
    rows += [(600, None), (601, ""), (602, rows[3][1]), (3, "the other text of one id, z@z.org zzzz"), (None, "no id here q@q.org qqqq")]
    rows += [(700 + k, f"Quorvax wrote {rng.choice(words)} from jo@site.org, said {rng.choice(words)}") for k in range(4)]
    want = brute_terms(rows)
    got = sorted((str(r.doc_id), r.spans) for r in P.find_pii(make(rows)).collect())
    full = sorted((str(i), ",".join(x for x in (P.joined(P.base_spans(t or "")), want[i, t]) if x)) for i, t in rows)
    assert got == full
    assert sum("generalise" in s for _, s in got) > 10 and sum("remove" in s for _, s in got) == 4


def test_texts_of_one_id_are_sanitised_apart(make):
    rows = corpus() + [(1001, "hi"), (None, "mail to a@b.org"), (1001, None)]
    out = [(r.doc_id, r.text) for r in P.sanitise(make(rows)).collect()]
    assert len(out) == len(rows) and (1001, "hi") in out and (1001, None) in out
    assert [t for i, t in out if i is None][0].endswith("[EMAIL]") and not any("@" in (t or "") for _, t in out)


def test_generalised_terms_become_their_class():
    assert P.redact("Ann met NASA by the river", "generalise:0:3,generalise:8:12,generalise:20:25,remove:13:15") == "[NAME] met [ACRONYM]  the [WORD]"
