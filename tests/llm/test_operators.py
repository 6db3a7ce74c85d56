"""The corpus operators against brute force, and their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from feedloom.llm import common
from feedloom.llm import op01_url_filter as op1
from feedloom.llm import op02_toxicity as op2
from feedloom.llm import op03_sharding as op3
from feedloom.llm import op04_pii as op4
from feedloom.llm import op05_bpe as op5
from feedloom.llm import op06_decontaminate as op6
from feedloom.llm import op07_jaccard_join as op7
from feedloom.llm import op08_quality as op8
from feedloom.llm import op09_line_dedup as op9
from feedloom.llm import op10_embedding_dedup as op10

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, cell int, row int, node long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ids and texts: unique ones, exact and near copies, repeated lines, empty, null, long, repeated rows."""
    out = [(i, prose(i, 30 + 7 * i)) for i in range(24)]
    base = prose(99, 120).split()
    for i in range(24, 40):
        words = list(base)
        for k in range(i % 5):
            words[(k * 31 + i) % 120] = f"changed{i}"
        out.append((i, " ".join(words)))
    line = "This line of text is repeated in many documents"
    out += [(i, f"{prose(i, 5)}\n{line}\n  {line.upper()} \n{prose(i + 1, 4)}") for i in range(40, 48)]
    out += [(48, ""), (49, None), (50, "one two"), (51, "one two"), (52, prose(7, 30_000)), (53, " \n \n"), (54, "x" * 50_000), (55, "1" * 30_000)]
    out += [out[3], out[3]]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), "clash", 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_rules_and_templates(spark):
    urls = ["http://A.example.net/en/x", "http://a.example.net/de/x", "https://example.com/de/", "http://m.example.com/fr/1", "http://b.org/fr/2", None, "no url", "http://h?q=/", "ftp://NET/"]
    pages = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, label_id long")
    labels = spark.createDataFrame([(0, 1), (None, 1), (3, None)], "label_id long, y int")
    got = {r["page_id"]: r for r in op1.judge(pages, labels, op1.RULES).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(9)] == [
        ("a.example.net", "/en/x", "example.net/en/"), ("a.example.net", "/de/x", "net/"), ("example.com", "/de/", "example.com/de/"), ("m.example.com", "/fr/1", None), ("b.org", "/fr/2", "org/fr/"),
        ("", "", None), ("", "", None), ("h", "", None), ("net", "/", "net/"),
    ]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4)] == ["allow", "block", "block", "allow"]
    assert op1.judge(pages.limit(0), labels, op1.RULES).count() == 0
    # a branch whose pages are mostly bad is kept apart from its siblings and blocked
    many = spark.createDataFrame([(i, f"http://h.com/{'bad' if i % 4 == 0 else 'good'}/{i}", i) for i in range(400)], "page_id long, url string, label_id long")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "label_id long, y int")
    judged = op1.judge(many, known, []).collect()
    assert {(r["template"], r["verdict"]) for r in judged} == {("/bad/*", "block"), ("/good/*", "allow")} or {r["verdict"] for r in judged if "/bad/" in r["path"]} == {"block"}


def test_small_section_of_large_host(spark):
    part = "CASE WHEN id % 100 = 7 THEN 'spam' ELSE concat('part', id % 90) END"  # 1 % of `large` is bad; over 50 sections
    large = spark.range(8_000).select(F.expr(f"concat('http://large.org/', {part}, '/', id)").alias("url"), F.expr("cast(id % 100 = 7 OR id % 25 = 3 AS int)").alias("y"))
    small = spark.range(160).select(F.expr("concat('http://small.org/', CASE WHEN id % 2 = 0 THEN 'spam' ELSE 'part' END, '/', id)").alias("url"), F.expr("cast(id % 2 = 0 AS int)").alias("y"))
    pages = common.cut(large.unionByName(small).withColumn("page_id", F.monotonically_increasing_id()), "pages").withColumn("label_id", F.col("page_id"))
    got = op1.judge(pages.drop("y"), pages.select("label_id", "y"), [])
    by = {(r["host"], r["bad"]): (r["verdicts"], r["n"]) for r in got.groupBy("host", F.expr("path LIKE '/spam/%'").alias("bad")).agg(F.collect_set("verdict").alias("verdicts"), F.count("*").alias("n")).collect()}
    assert by == {("large.org", True): (["block"], 80), ("large.org", False): (["allow"], 7920), ("small.org", True): (["block"], 80), ("small.org", False): (["allow"], 80)}


def test_toxicity(spark, docs, empty):
    rows = [(1000 + i, ("you idiot " if i % 3 == 0 else "") + prose(i, 25)) for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 1000 % 3)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    labels = labels.withColumn("toxic", F.when(F.col("doc_id") >= 1000, ((F.col("doc_id") - 1000) % 3 == 0).cast("int")).otherwise(F.col("toxic")))
    model = op2.fit(op2.training_rows(train, labels, "toxic"))
    got = {r["doc_id"]: r["score"] for r in op2.score(train, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum((got[i] >= 0.5) == ((i - 1000) % 3 == 0) for i in held) >= 0.9 * len(held)
    every = op2.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r["score"] <= 1 for r in every)
    assert op2.score(empty, model).count() == 0
    assert op2.fit(op2.training_rows(train, labels.limit(0), "toxic"))[2] == 0


def test_sharding(spark, docs, texts, empty):
    for n in (1, 7, 40, 100):
        rows = op3.shard(docs, "doc_id", "text", n).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts)
        counts = Counter(r["shard"] for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(n)) <= 1 and set(counts) <= set(range(n))
        for s in counts:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    by = dict(texts)
    assert all(r["text_crc32"] == zlib.crc32((by[r["doc_id"]] or "").encode()) and r["size"] == len((by[r["doc_id"]] or "").encode()) + 16 for r in rows)
    assert op3.shard(empty, "doc_id", "text").count() == 0
    same = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    assert {r["n"] for r in op3.shard(same, "doc_id", "text", 4).groupBy("shard").agg(F.count("*").alias("n")).collect()} == {2500}


def test_sharding_moves_little(spark):
    keys = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    before, after = ({r["doc_id"]: r["shard"] for r in op3.shard(keys, "doc_id", "text", n).collect()} for n in (40, 41))
    moved = sum(before[i] != after[i] for i in range(40_000)) / 40_000
    assert len(before) == len(after) == 40_000 and moved < 0.06, moved
    positions, _ = op3._ring(7, 3)
    ranges = op3.arc_ranges(positions)
    for pos in [-(2**63), 2**63 - 1, *positions, *[p + 1 for p in positions], *[random.Random(p).randrange(-(2**63), 2**63) for p in positions]]:
        hits = [x["arc"] for x in ranges if (x["after"] is None or pos > x["after"]) and pos <= x["upto"] and x["cell"] == pos >> (64 - op3.CELL_BITS)]
        assert hits == [next((i for i, p in enumerate(positions) if p >= pos), 0)]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if name == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if name == "card" and not (12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0):
                continue
            if name == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans():
    r = random.Random(5)
    for _ in range(20_000):
        text = "".join(r.choice("a@.-_%+ 0123456789b()1é@..4 ") for _ in range(r.randrange(50)))
        assert op4.base_spans(text) == plain_spans(text), text


def test_pii_finds_unseen(spark, docs, empty):
    good = [c for c in (f"41{i:014d}" for i in range(100, 300)) if op4._luhn(c)][:12]
    rows = [(i, f"{prose(i, 3)} card {c} paid") for i, c in enumerate((good * 2)[:21])] + [(100, f"{prose(9, 3)} card 4111111111111112 paid"), (101, None), (102, ""), (103, "nr 12345678901")]
    found = {r["doc_id"]: r for r in op4.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == len(rows) and [s["kind"] for s in found[100]["added"]] == [2] and not found[100]["base"]
    assert not found[101]["base"] and not found[103]["added"]
    assert all(r["base"] for i, r in found.items() if i < 21)
    assert op4.extract(docs).count() == docs.count() and op4.extract(empty).count() == 0


def test_pii_finds_unseen_of_every_shape(spark):
    r = random.Random(11)
    seeds = {
        "mail": [f"{a}.{b}@firma.de" for a, b in zip(WORDS[:10], WORDS[5:])], "host": [f"10.{i}.0.{i + 3}" for i in range(10)],
        "card": [c for c in (f"41{i:014d}" for i in range(100, 300)) if op4._luhn(c)][:10], "call": [f"+49 {170 + i} 55{i}1 234" for i in range(10)],
    }
    rows = [(f"{prose(i, 3)} {word} {value} {prose(i + 50, 3)}",) for word, values in seeds.items() for i, value in enumerate(values)]
    unseen = [("mail", "paul@firma", 0), ("mail", "paul (at) firma.de", 0), ("host", "1.2.3.400", 1), ("card", "4111 1111 1111 1112", 2), ("call", "0171 555 1234", 3), ("call", "(0171) 555-1234", 3)]
    rows += [(f"{prose(i + 90, 3)} {word} {value} {prose(i + 200, 3)}",) for i, (word, value, _) in enumerate(unseen)]
    rows += [(f"{prose(i + 300, 3)} nr {value} {prose(i + 400, 3)}",) for i, value in enumerate(("0171 555 1234", "4111 1111 1111 1112"))]
    r.shuffle(rows)
    got = op4.extract(spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "doc_id long, text string")).collect()
    text = {i: t for i, (t,) in enumerate(rows)}
    added = sorted((text[x["doc_id"]][s["start"] : s["end"]], s["kind"]) for x in got for s in x["added"] if " nr " not in text[x["doc_id"]])
    assert added == sorted((value, kind) for _, value, kind in unseen)
    for n in (20_000, 40_000):  # time in proportion to the text
        for piece in ("1 ", "1.", "a@", "a at ", "(", "1-", "x" + " at "):
            op4.found_in(piece * n + "x")


def test_pii_two_steps(spark):
    cards = [c for c in (f"41{i:014d}" for i in range(100, 3000)) if op4._luhn(c)]
    wrong = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards[100:121]]
    rows = [f"card {c} paid" for c in cards[:100] + wrong[:20]] + [f"konto {c} euro" for c in wrong]
    got = op4.extract(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {x["doc_id"]: [s["kind"] for s in x["added"]] for x in got if not x["base"]} == {i: [2] for i in range(100, 141)}


def test_bpe(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    path = op5.vocabulary_path()
    ref = Tokenizer.from_file(path)
    odd = [(900 + i, t) for i, t in enumerate(["<|endoftext|> a<|startoftext|>", "ΑΣ ΟΔΟΣ İ", "don't we'll 's", "é é ﬀ½Ⅷ", "a\x1cb\x85c\xa0d", "漢字🎉👍🏽", "\x00\x7f", "ab" * 5000])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = op5.decode(op5.encode(df, path).withColumnRenamed("decoded", "first"), path).collect()
    by = dict(texts) | dict(odd)
    assert len(got) == len(texts) + len(odd)
    for r in got:
        e = ref.encode(by[r["doc_id"]] or "", add_special_tokens=False)
        assert bytes(r["ids"]) == struct.pack(f"<{len(e.ids)}I", *e.ids), r["doc_id"]
        assert r["first"] == r["decoded"] == ref.decode(e.ids, skip_special_tokens=False)
    assert op5.encode(empty, path).count() == 0


def test_decontamination(spark, docs, empty):
    items = [(i, prose(500 + i, 25)) for i in range(20)] + [(20, None), (21, ""), (22, "short"), (None, prose(1, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    r, rows = random.Random(3), []
    for i in range(60):
        text = prose(2000 + i, 60 + 40 * (i % 4))
        if i % 2:
            b = list(items[i % 20][1])
            for _ in range(int(0.05 * len(b))) if i % 4 == 3 else ():
                b[r.randrange(len(b))] = r.choice("abcxyz")
            at = r.randrange(len(text))
            text = text[:at] + " " + "".join(b).upper().replace(" ", "\n ") + " " + text[at:]
        rows.append((i, text))
    found = op6.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(i, i % 20) for i in range(60) if i % 2}
    text = dict(rows)
    for x in found:
        if x["edits"] == 0:
            piece = re.sub(r"\s+", " ", text[x["doc_id"]][x["start"] : x["end"]].lower())
            assert piece in items[x["item_id"]][1] or items[x["item_id"]][1] in piece
    assert op6.find(docs, bench).where("item_id < 20").count() == 0
    assert op6.find(empty, bench).count() == 0 and op6.find(docs, bench.limit(0)).count() == 0


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = ({tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}) if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, texts, empty, k, percent):
    want = brute_components(texts, k, percent)
    got = op7.join(docs, k, percent).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_jaccard_join_empty(empty):
    assert op7.join(empty).count() == 0


def test_jaccard_crowd(spark):
    """A large group of near copies that link through their original only."""
    base, rows = prose(77, 100).split(), []
    for i in range(120):
        words, r = list(base), random.Random(i)
        for _ in range(r.randrange(9)):
            words[r.randrange(100)] = f"new{i}x{r.randrange(99)}"
        rows.append((i, " ".join(words)))
    got = op7.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 3, 80)


def test_quality(spark, docs, empty):
    junk = lambda i: " ".join(w + "***" for w in prose(i, 60).split())
    rows = [(i, junk(i) if i % 4 == 0 else prose(i, 60).capitalize() + ".", "en", f"s{i % 3}", 400) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(200)] + [(None, 1), (300, None)], "doc_id long, quality int")
    model = op8.train(table, labels)
    got = {r["doc_id"]: r["_keep"] for r in op8.classify(table, model).collect()}
    assert all(got[i] == (i % 4 != 0) for i in range(400))
    out = op8.classify(docs, model)
    assert out.count() == docs.count() and out.columns[: len(docs.columns)] == docs.columns
    assert op8.classify(empty, model).count() == 0
    assert op8.train(table, labels.limit(0)) is None and op8.classify(docs, None).where("_keep").count() == docs.count()


def test_line_dedup(docs, texts, empty):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    holders = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    got = op9.with_bitmaps(docs).select("doc_id", "text", op9.kept_text(F.col("text"), F.col("_keep")).alias("kept"), "_dropped").collect()
    assert len(got) == len(texts)
    for r in got:
        lines = (r["text"] or "").split("\n")
        stay = [x for x in lines if key(x) not in lost or lost[key(x)] == r["doc_id"]]
        assert r["kept"] == "\n".join(stay) and (r["_dropped"] or 0) == len(lines) - len(stay)
    assert lost and op9.with_bitmaps(empty).count() == 0


def test_line_dedup_hot_line(spark):
    """A line that all documents share is settled by counts, not in one window."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a line that is in every document\nown line number "), F.col("id"), F.lit(" of its own text")).alias("text"))
    got = op9.keep_bitmaps(rows)
    assert got.count() == 2999 and got.where("n_dropped <> 1 OR doc_id = 2999").count() == 0


@pytest.mark.parametrize("block,cell", [(1024, 2048), (4, 6)])
def test_embeddings(spark, monkeypatch, block, cell):
    import numpy as np

    monkeypatch.setattr(op10, "BLOCK", block)
    monkeypatch.setattr(op10, "CELL", cell)
    r = np.random.default_rng(4)
    centres, rows = r.normal(size=(12, 8)), []
    for i in range(150):
        rows.append((i, (centres[i % 12] + (0.15 * r.normal(size=8) if i % 5 else 0)).tolist(), int(i % 2)))
    rows += [(150, None, 0), (151, [0.0] * 8, 0), (152, [float("nan")] + [1.0] * 7, 1), (153, [None] + [1.0] * 7, 1), (154, rows[0][1], None), (155, [1.0, 2.0], 0), (156, [1.0, 2.0], 0), (157, [], 0)]
    got = {x["vec_id"]: x for x in op10.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    up = {i: i for i in got}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for a, x, c in ok:
        for b, y, d in ok:
            if a != b and c == d and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a] += 1
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    assert links and all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], top(i), top(i) == i) for i, _, _ in rows)


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(900, j) for j in range(901, 960)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up}


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {re.match(r"op(\d+)_", n)[1] for n in names if n.startswith("op")} == {str(i) for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names
    assert hashlib.sha256(b"").hexdigest()
