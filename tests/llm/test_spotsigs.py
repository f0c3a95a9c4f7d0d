import hashlib
import random

from orrery.llm import spotsigs as S
from pyspark.sql import functions as F


def brute_edit(rows):
    order = sorted(rows, key=lambda r: r[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())
    return out


def report(df):
    return {r.doc_id: r for r in df.collect()}


def members(fingerprint):
    n, digits = fingerprint.split(":")
    found = {digits[k : k + 8] for k in range(0, len(digits), 8)}
    assert int(n) == len(found) and 8 * len(found) == len(digits)
    return found


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(rows, got):
    want = brute_edit(rows)
    order = sorted(want)
    for k, i in enumerate(order):
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == want[i]
        mine, nxt = members(r.fingerprint), members(got[order[(k + 1) % len(order)]].fingerprint)
        assert abs(r.near_edited - jaccard(mine, members(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - jaccard(mine, nxt)) < 1e-12


def test_odd_texts(make, odd_texts):
    rows = list(enumerate(odd_texts))
    got = report(S.edit_report(make(rows)))
    check(rows, got)
    assert got[10].fingerprint == got[11].fingerprint and got[0].fingerprint == got[1].fingerprint == "0:"


def test_clustered_ids_over_many_buckets(make, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 2)
    rng = random.Random(3)
    ids = [*range(50), *(10**15 + 7 * k for k in range(60)), *rng.sample(range(-(10**12), 10**12), 40)]
    rows = [(i, f"the cat {i} sat on a mat " * (i % 4)) for i in ids]
    check(rows, report(S.edit_report(make(rows))))


def test_single_and_empty_tables(make):
    assert report(S.edit_report(make([(5, "abcd")])))[5].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert S.edit_report(make([])).count() == 0


def test_repeated_rows_follow_each_other(make):
    rows = [(1, "aa bb"), (1, "aa bb"), (2, "cc")]
    got = sorted((r.doc_id, r.edited_sha256) for r in S.edit_report(make(rows)).collect())
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, h("aa aa")), (1, h("aa cc")), (2, h("ca"))])


def test_signatures_follow_anchors(spark):
    text = "Red the quick, brown fox of the old house"
    sig = lambda t: set(spark.range(1).select(S.signatures(F.lit(t))).first()[0])
    hashes = lambda *parts: spark.range(1).select(F.hash(*map(F.lit, parts))).first()[0]
    assert {hashes("the", "quick brown"), hashes("of", "old house"), hashes("the", "old house"), hashes("red", "the", "quick")} <= sig(text)
    assert sig(text) == sig("  RED the quick brown\n fox -- of the OLD house.") and sig("...") and not sig("")


def test_half_edited_texts_stay_near(spark):
    got = S.op7_spotsigs(spark, "/root/testdata/sf0.001").toPandas()
    assert (got.near_edited > got.near_next).mean() > 0.95 and got.near_next.mean() < 0.05


def test_links_between_near_copies(make):
    rng = random.Random(1)
    words = ["the", "of", "and"] + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    base = [rng.choice(words) for _ in range(400)]
    near = [f"other{w}" for w in base[:60]] + base[60:]
    rows = [(4, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.choice(words) for _ in range(400))), (9, " ".join(base)), (7, None)]
    got = [(r.a, r.b) for r in S.spot_links(make(rows), 0.5).collect()]
    assert got == [(2, 4)]


def test_links_are_those_of_brute_force(make, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(6)
    words = ["the", "of", "and"] + [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(0, "the only text of its kind")]
    for family in range(3):
        base = [rng.choice(words) for _ in range(120)]
        for k in range(25):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 - 100 * family - k, " ".join(text[: rng.choice([120, 120, 110, 90])])))
    docs = make(rows)
    for least in (0.5, 0.8):
        sets = {}
        for r in docs.select("doc_id", S.signatures(F.col("text")).alias("s")).collect():
            key = frozenset(r.s)
            sets[key] = min(r.doc_id, sets.get(key, r.doc_id))
        found = sorted((i, s) for s, i in sets.items())
        want = sorted((a, b) for k, (a, s) in enumerate(found) for b, t in found[k + 1 :] if len(s & t) / len(s | t) >= least)
        got = sorted((r.a, r.b) for r in S.spot_links(docs, least).collect())
        assert got == want and len(want) > 20


def parts_of(text):
    """What each signature hashes, by plain loops over the words: a common word with the next content words, and triples."""
    import re

    spaced = re.sub("([\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff])", r" \1 ", text)
    words = re.findall(r"[^\W_]+", spaced.lower())
    common = set(S.ANCHORS.split())
    chains = []
    for k, w in enumerate(words):
        if w in common:
            chain, passed = [], 0
            for x in words[k + 1 :]:
                if x in common:
                    passed += 1
                    if passed > S.PASSED:
                        break
                elif len(chain) < S.CHAIN:
                    chain.append(x)
            chains.append((w, " ".join(chain)))
    triples = [tuple(words[k : k + S.CHAIN + 1]) for k in range(len(words) - S.CHAIN)]
    return words, chains, triples


def test_signatures_against_plain_loops(spark, make):
    rng = random.Random(21)
    words = ["the", "of", "and", "für", "el", "Über", "river", "stone", "x1", "42", "naïve", "Zürich", "glass,", "door.", "(wind)", "the-end"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["日本語のテキスト", "one", "the", "the of", "a b", "the cat"]
    for text, got in zip(texts, (set(r.s) for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", S.signatures(F.col("t")).alias("s")).orderBy("k").collect())):
        said, chains, triples = parts_of(text)
        if len(said) > S.CHAIN:
            hashed = spark.createDataFrame([(said[k], *t) for k, t in enumerate(triples)], "w string, a string, b string, c string").select("w", F.hash("a", "b", "c").alias("h"), (F.pmod(F.hash("w"), F.lit(S.HASHED)) == 0).alias("on")).collect()
            want = {r.h for k, r in enumerate(hashed) if k == 0 or r.on}
        else:
            want = {spark.range(1).select(F.hash(F.lit(" ".join(said)))).first()[0]}
        if chains:
            want |= {r.h for r in spark.createDataFrame(chains, "a string, c string").select(F.hash("a", "c").alias("h")).collect()}
        assert got == want, text


def test_scripts_without_spaces_have_words(spark):
    near = lambda a, b: spark.range(1).select(S.likeness(S.signatures(F.lit(a)), S.signatures(F.lit(b)))).first()[0]
    a = "今天天气很好我们一起去公园散步然后回家吃饭看书睡觉明天再去学校上课学习新的知识和朋友们聊天"
    assert near(a, a[:-2] + "玩耍") > 0.5 > near(a, a[::-1])


def test_ids_at_the_ends_of_their_range(make, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 1)
    rng = random.Random(8)
    ids = sorted({-(1 << 63), (1 << 63) - 1, (1 << 63) - 2, 0, -1, 1, *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(40))})
    rows = [(i, f"the word {i} of a text " * (k % 3)) for k, i in enumerate(ids)]
    check(rows, report(S.edit_report(make(rows))))
