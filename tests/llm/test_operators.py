"""Edge cases and brute-force comparisons of the corpus operators on small tables."""

import collections
import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeway.llm import ann, brown, graph, linedup, mixing, pii, rules, site_quality, spm, supermin, warc
from ridgeway.llm import textblocks as tb

sys.path.insert(0, str(Path(__file__).parent))
import models  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, hash string, n long, rep long"
WORDS = [f"w{i}" for i in range(400)]


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "x", 2, 3) for i, t, s in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def lower(text):
    return bytes((text or "").encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(60)]
    line = "This very line is shared by many documents, all of them."
    rows = [(1, None, "a"), (2, "", "a"), (3, "  \n\t\n", None), (4, "one", "b"), (4, "one", "b"), (5, "One", "b"), (None, "x y z " * 9, "b"), (6, "é\x00 " + "z" * 3000, "c"), (7, ("long " + " ".join(WORDS) + "\n") * 200, "a")]
    for k in range(12):
        own = list(base)
        for _ in range(k // 2):
            own[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((10 + k, " ".join(own[:30]) + "\n  " + (line.upper() if k % 2 else line) + " \n" + " ".join(own[30:]), "ab"[k % 2]))
    rows += [(100 + k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 40))), "abc"[k % 3]) for k in range(20)]
    rows += [(200, "A | B | C # D $ E % F & G < H > * " * 5, "b"), (201, "SHOUT LOUD AND LONG AND CLEAR FOR ALL TO HEAR NOW", "c")]
    return table(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_and_line_positions():
    texts = [None, "", "a  bé\n\x0bc", "x" * 3000, "\n\n", " z"]
    blocks = list(tb.blocks(pa.array(texts), 1000))
    got = [(b.first + r, b.data[s:e].tobytes()) for b in blocks for r, s, e in zip(*b.words())]
    assert got == [(i, w) for i, t in enumerate(texts) for w in words(t)]
    lines = [(b.first + r, b.data[s:e].tobytes()) for b in blocks for r, s, e in zip(*b.lines())]
    assert lines == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split(b"\n")]


def brute_rules(text):
    ws = words(text)
    win = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = collections.Counter(win)
    covered = {j for i, w in enumerate(win) if n[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    chars = sum(len(w.decode()) for w in ws)
    return (len(ws), chars, sum((text or "").count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)), len(covered), len(lines))


def test_rule_measures_and_policies(spark, docs, empty):
    book = rules.ledger(docs).collect()
    want = sorted((repr(r["doc_id"]), *brute_rules(r["text"])) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), *(r[k] for k in rules.MEASURES[:6])) for r in book) == want
    kept = {r["doc_id"] for r in rules.keep_passing(docs, "strict-1").collect()}
    assert 100 in kept or 101 in kept and not kept & {1, 2, 3, 4, 200, 201}
    assert rules.keep_passing(docs, "base-1").columns == docs.columns
    assert rules.ledger(empty).count() == 0
    few = {r["rule"]: r for r in rules.ablations(rules.ledger(docs), "strict-1").collect()}
    masks = [r["failed"] for r in book]
    for k, name in enumerate(rules.RULES):
        assert few[name]["failing"] == sum(m >> k & 1 for m in masks) and few[name]["failing_alone"] == sum(m == 1 << k for m in masks)


def test_line_dedup_against_brute_force(docs, empty):
    rows = docs.collect()
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r")).decode()
    holders = collections.defaultdict(set)
    for r in rows:
        for x in (r["text"] or "").split("\n") if r["doc_id"] is not None else ():
            if len(key(x)) >= 40:
                holders[key(x)].add(r["doc_id"])
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert gone
    want = sorted((repr(r["doc_id"]), None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if r["doc_id"] is None or gone.get(key(x), r["doc_id"]) == r["doc_id"])) for r in rows)
    got = linedup.dedup_lines(docs)
    assert got.columns == docs.columns and sorted(map(str, want)) == sorted(str((repr(r["doc_id"]), r["text"])) for r in got.collect())
    assert linedup.dedup_lines(empty).count() == 0


def test_keep_bitmaps_are_what_the_drop_maps_lack(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join("x" for _ in range(n)), {w: rng.getrandbits(63) for w in range(n // 64 + 1) if rng.random() < 0.6} or None) for i, n in enumerate((1, 63, 64, 65, 128, 200))]
    df = spark.createDataFrame(rows, "id int, text string, drop map<int, bigint>")
    for r in df.select("text", "drop", linedup.keep_words(F.col("text"), F.col("drop")).alias("k"), F.transform(linedup.split_lines(F.col("text")), lambda _, i: F.coalesce(linedup.is_dropped(F.col("drop"), i), F.lit(False))).alias("gone")).collect():
        keep = [bool(r["k"][i // 64] >> (i % 64) & 1) for i in range(len(r["gone"]))]
        assert keep == [not x for x in r["gone"]] and all(w >> (len(keep) % 64) == 0 for w in r["k"][-1:] if len(keep) % 64)


def test_hot_lines_take_the_other_route(docs, monkeypatch):
    a = sorted(map(str, linedup.dedup_lines(docs).collect()))
    monkeypatch.setattr(linedup, "PROBE", 1)
    monkeypatch.setattr(F, "greatest", lambda *c, f=F.greatest: f(F.lit(2.0), c[1]) if len(c) == 2 else f(*c))
    assert sorted(map(str, linedup.dedup_lines(docs).collect())) == a


def shingle_set(text, size):
    ws = lower(text).split()
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()


def brute_components(rows, size=5):
    parent = {r["doc_id"]: r["doc_id"] for r in rows if r["doc_id"] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = [(r["doc_id"], shingle_set(r["text"], size)) for r in rows if r["doc_id"] is not None]
    for i, (a, x) in enumerate(some):
        for b, y in some[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(docs, empty, size):
    rows = docs.collect()
    want = brute_components(rows, size)
    got = supermin.near_duplicates(docs, size).collect()
    assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]]) for r in got if r["doc_id"] is not None)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [True]
    kept = supermin.keep_one_each(docs, size)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({r for r, c in want.items() if r == c})
    assert supermin.near_duplicates(empty, size).count() == 0


def test_chains_of_edits_stay_linked(spark):
    """Copies of copies, of which the first and last don't link, and a crowd of near misses with edits of their own."""
    rng = random.Random(8)
    text, rows = [f"t{i}" for i in range(120)], []
    for k in range(40):
        rows.append((k * 3 % 40 + 1000, " ".join(text), "a"))
        text[rng.randrange(120)] = f"u{k}"
    for k in range(60):
        own = [f"v{i}" for i in range(60)]
        for j in range(rng.randint(2, 5)):
            own[rng.randrange(60)] = f"x{k}-{j}"
        rows.append((k, " ".join(own), "b"))
    df = table(spark, rows)
    want = brute_components(df.collect(), 4)
    assert {r["doc_id"]: r["component_id"] for r in supermin.near_duplicates(df, 4).collect()} == want
    assert len(set(want.values())) > 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (20, 50, 80):
        pool = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = pool[:100], pool[100 - shared : 200 - shared]
        sig = supermin.signatures(np.repeat([0, 1], 100), np.concatenate([a, b]), 2, 256)
        assert abs((sig[0] == sig[1]).mean() - shared / (200 - shared)) < 0.12
    lone = supermin.signatures(np.zeros(1, np.int64), np.array([7], np.uint64), 1)
    assert len(set(lone[0] >> np.uint64(56))) == supermin.POSITIONS  # one element ranks every position differently


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(k, k + 1) for k in range(200, 260)] + [(None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    got = {r["v"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


def test_mix_reaches_its_targets(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, goal, largest = (collections.Counter() for _ in range(4))
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]], largest[r["source"]] = r["target"], max(largest[r["source"]], r["size"])
    # shares, by hand
    order, todo = sorted(sizes, key=lambda s: (s is None, s or "")), 1.5 * sum(sizes.values())
    weight, want, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, set(order)
    while open_:
        level = todo / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            want |= {s: weight[s] * level for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        todo -= sum(2 * sizes[s] for s in over)
        open_ -= over
    assert all(abs(goal[s] - want[s]) < 1e-6 and abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and abs(sum(len(words(r["text"])) for r in out.collect()) - sum(taken.values())) <= max(largest.values())


def test_pieces_match_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = spm.PieceModel(spm.read_model(MODEL))
    rng = random.Random(3)
    texts = ["", " ", "   a  b ", "\n", "a\n b\n\nc", "<s> <0x41> </s>", "é梦🙂\x00", "▁a▁b", "        x", "aaaaaaaaaaaaa"]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(1, 30))) for a in ("ab ", "the \n", "é梦🙂 \t<s>", " ", "a▁ ", "0123 .,-_=") for _ in range(150)]
    for t in texts:
        ids = lib.encode(t)
        assert model.encode(t) == ids and model.decode(ids) == lib.decode(ids)
    for alphabet in ("etaoinshr", "é梦🙂1_-", "=-"):  # parts without a cut, below and beyond the kept length
        for n in (spm.KEPT_LENGTH - 1, spm.KEPT_LENGTH, spm.KEPT_LENGTH + 1, 3000):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert model.encode(t) == lib.encode(t)
    assert max(map(len, model.last)) <= spm.KEPT_LENGTH
    got = sorted(map(str, (tuple(r) for r in spm.digests(docs, MODEL).collect())))
    hexa = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r["doc_id"], len(i := lib.encode(r["text"] or "")), hexa(",".join(map(str, i))), hexa(lib.decode(i))) for r in docs.collect()]
    assert got == sorted(map(str, want)) and spm.digests(empty, MODEL).count() == 0
    back = spm.decode(spm.encode(docs, MODEL), MODEL)
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(str((r["doc_id"], lib.decode(lib.encode(r["text"] or "")))) for r in docs.collect())


def test_pieces_are_compared_without_merging(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = spm.PieceModel(spm.read_model(MODEL))
    rng = random.Random(4)
    pieces = sorted(p for p in model.ids if not any(two in p for two in model.ties))
    pairs = [(a, b) for a in pieces[::400] for b in pieces[7::300]] + [(p, p) for p in pieces[::5]] + [(p[:k], p[k:]) for p in pieces[::9] for k in range(1, len(p)) if {p[:k], p[k:]} <= model.ids.keys()]
    for word in ("banana", "nonononon", "hahahaha", "ininin", "eeeeeee", "======"):
        pairs += [(word[:k], word[k:]) for k in range(1, len(word)) if {word[:k], word[k:]} <= model.ids.keys()]
    pairs = [(a, b) for a, b in pairs if not any(two in a + b for two in model.ties)]
    assert all(model._stay_apart(a, b) == (model.merge(a + b) == [a, b]) for a, b in pairs)
    monkeypatch.setattr(model, "merge", None)  # no longer called, but for runs of blanks
    for _ in range(50):
        t = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "$s"]) for _ in range(40))
        assert model.encode(t) == lib.encode(t)


def test_pieces_of_frequent_words_outlast_a_full_table(monkeypatch):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = spm.PieceModel(spm.read_model(MODEL))
    monkeypatch.setattr(spm, "KEPT_PARTS", 40)
    made = []
    part_ids = model.part_ids
    monkeypatch.setattr(model, "part_ids", lambda part: made.append(part) or part_ids(part))
    for k in range(60):
        t = "the frequent words and " + " ".join(f"w{k}x{j}" for j in range(9))
        assert model.encode(t) == lib.encode(t)
        assert len(model.parts) <= 40 and len(model.older) <= 40
    assert len(made) == len(set(made)) == 4 + 60 * 9
    long = " ".join(f"v{j}" for j in range(500))  # more words than are kept
    assert model.encode(long) == lib.encode(long) and len(model.parts) <= 40


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "u1", "aé"), (2, "u2", "aé"), (3, None, None), (4, "u4", ""), (5, "u\r\n5", "WARC/1.1\r\n\r\nx\r\n\r\n"), (None, "u6", "aé"), (7, "u7", "aé"), (7, "u7", "aé")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(pages, f"{tmp_path}/a")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_index(spark, f"{tmp_path}/a").collect()}
    assert got == {(1, "revisit", 7, 3), (2, "revisit", 7, 3), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 17), (None, "response", None, 3), (7, "response", None, 3)}
    import base64

    one = next(r for r in warc.read_index(spark, f"{tmp_path}/a").collect() if r["page_id"] == 5)
    assert one["payload_digest"] == base64.b32encode(hashlib.sha1(rows[4][2].encode()).digest()).decode()
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 3
    warc.export_warc(spark, f"{tmp_path}/a", f"{tmp_path}/w")
    records = warc.import_warc(spark, f"{tmp_path}/w").collect()
    assert sorted(bytes(r["block"]).decode() for r in records if "WARC-Type: response" in r["header"]) == sorted(["", rows[4][2], "aé", "aé", "aé"])
    assert sorted(r["header"] for r in records) == sorted(r["header"] for r in warc.read_records(spark, f"{tmp_path}/a").collect())
    warc.write_archive(pages.limit(0), f"{tmp_path}/e")
    assert warc.read_index(spark, f"{tmp_path}/e").count() == 0


def test_personal_data(spark, empty):
    text = 'é mail a.b+c@x-y.org, x@y @z.com 10.0.0.256 1.2.3.4.5.6.7.8 or 4111 1111 1111 1111 and 4111111111111112 call +1 (377) 555-0271. token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" end'
    rows = [(1, None, "a"), (2, "", "a"), (3, text, "a"), (4, "9" * 50000 + "." * 500 + "a" * 50000 + "@", "a"), (5, "plain words only\n" * 50, "b")]
    got = {r["doc_id"]: r for r in pii.detect(table(spark, rows)).collect()}
    at = text.index
    card, phone, key = "4111 1111 1111 1111", "+1 (377) 555-0271", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    base = ",".join(f"{k}:{at(v)}:{at(v) + len(v)}" for k, v in (("email", "a.b+c@x-y.org"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", card), ("phone", phone)))
    r = got[3]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 2, 1, 1) and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert r["spans"].startswith(base) and f"secret:{at(key)}:{at(key) + len(key)}" in r["spans"]
    assert all(got[k]["spans"] == "" for k in (1, 2, 5)) and pii.detect(empty).count() == 0


def test_field_decodes_like_plain_viterbi_and_generalises():
    field = pii._field()
    rng = np.random.default_rng(0)
    code = rng.integers(0, pii.N_SHAPES, 60)
    size = np.array([0, 1, 7, 12, 0, 40])
    got, at = field.decode(code, size), 0
    for n in size:
        best = None
        for j in range(n):
            e = field.emit[code[at + j]]
            best = [(field.first[y] + e[y], [y]) for y in range(6)] if best is None else [max(((s + field.trans[p[-1], y] + e[y], [*p, y]) for s, p in best), key=lambda z: z[0]) for y in range(6)]
        if n:
            assert max(((s + field.last[p[-1]], p) for s, p in best), key=lambda z: z[0])[1] == got[at : at + n].tolist()
        at += n
    assert field.plain_is_other
    right = total = 0
    for line in pii.made(200, 77):  # lines drawn with another seed
        data = " ".join(w for w, _ in line).encode()
        block = tb.Block(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        _, s, e = block.words()
        y = field.decode(pii.shapes(block.data, s, e, np.arange(len(s)) == 0), np.array([len(s)]))
        right, total = right + int((y == [k for _, k in line]).sum()), total + len(line)
    assert right / total > 0.97


def test_language_model(spark, docs, empty):
    got = brown.scores(docs).collect()
    rows = docs.collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = collections.Counter(w for r in rows if not held(r["doc_id"]) for w in [*lower(r["text"]).split(), None])
    n, v = sum(c.values()), len(c)

    def base(text):
        return sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*lower(text).split(), None])

    want = sorted((repr(r["doc_id"]), held(r["doc_id"]), len(lower(r["text"]).split()) + 1, round(base(r["text"]), 6)) for r in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n} and all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert brown.scores(empty).count() == 0


def test_class_model_is_a_distribution_and_beats_the_unigram(spark):
    rng = random.Random(5)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(k, " ".join(rng.choice(a if j % 2 else b) for j in range(40)), "s") for k in range(300)]
    df = table(spark, rows)
    tally = brown.counts(df)
    m = brown.train(df, tally)
    tail = m.tokens - m.count.sum() + brown.ADD * (m.types - len(m.word) + 1)
    for before in set(m.cls.tolist()):
        mass = (10 ** (m.step[before, m.cls] + m.emit)).sum() + 10 ** m.step[before, m.tail] * tail / 10**m.tail_scale
        assert 0.98 < mass <= 1 + 1e-6
    s = brown.scores(df).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert s[0] > s[1] + 100


def test_every_word_has_an_exchange_class_whatever_the_head(spark, monkeypatch):
    rng = random.Random(6)
    a, b = [f"a{i}" for i in range(2000)], [f"b{i}" for i in range(2000)]  # far more than are exchanged, most of them rare
    pick = lambda s: s[min(int(rng.paretovariate(0.5)) - 1, 1999)]
    df = table(spark, [(k, " ".join(pick(a if j % 2 else b) for j in range(40)), "s") for k in range(300)])
    monkeypatch.setattr(brown, "CLUSTERED", 64)
    tally = brown.counts(df)
    m = brown.train(df, tally)
    h = {w: int(brown._tokens(next(tb.blocks(pa.array([w]))))[1][0]) for w in a + b}
    cls = dict(zip(m.word.tolist(), m.cls.tolist()))
    side = lambda ws: {cls[h[w]] for w in ws if h[w] in cls}
    assert set(m.cls.tolist()) <= set(range(brown.CLASSES + 1)) and len(cls) > 200
    assert not side(a) & side(b)
    got = [sorted(map(tuple, brown.scores(df).select("doc_id", "n_known", F.round("score", 6)).collect()))]
    monkeypatch.setattr(brown, "HEAD", 100)
    got.append(sorted(map(tuple, brown.scores(df).select("doc_id", "n_known", F.round("score", 6)).collect())))
    assert got[0] == got[1]


def test_exchange_ends_where_no_move_raises_the_likelihood():
    rng = np.random.default_rng(4)
    big = rng.poisson(rng.gamma(0.2, 4, (24, 24))).astype(float)

    def likelihood(own, k):
        n = np.eye(k)[own].T @ big @ np.eye(k)[own]
        h = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return h(n) - h(n.sum(axis=0)) - h(n.sum(axis=1))

    own = brown.exchange(big, 22, 4, np.array([4, 5]))
    for w in range(22):
        for c in range(4):
            moved = own.copy()
            moved[w] = c
            assert likelihood(moved, 6) <= likelihood(own, 6) + 1e-6


def test_exchange_only_raises_the_likelihood():
    rng = np.random.default_rng(2)
    big = rng.poisson(np.where(np.add.outer(np.arange(20), np.arange(20)) % 2 == 0, 8, 1)).astype(float)

    def likelihood(own, k):
        one = np.eye(k)[own]
        n = one.T @ big @ one
        h = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
        return h(n) - h(n.sum(axis=0)) - h(n.sum(axis=1))

    own = brown.exchange(big, 18, 2, np.array([2, 3]))
    start = np.concatenate([np.arange(18) % 2, [2, 3]])
    assert likelihood(own, 4) >= likelihood(start, 4) and own[18:].tolist() == [2, 3]


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)) + np.repeat(rng.normal(size=(6, 16)) * 2, 100, axis=0)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(1000 + k, x[5].tolist(), 1) for k in range(200)] + [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] * 16, 1), (5200, [1.0, 2.0], 1), (None, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest(df, F.col("id") % 50 == 0).collect()
    live = [(i, np.array(v)) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in live])
    ids = np.array([i for i, _ in live])
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and q not in [v for _, v, _ in mine]
        score = unit @ unit[list(ids).index(q)]
        best = sorted((-round(s, 12), i) for s, i in zip(score, ids) if i != q)[:5]
        hit, total = hit + len({i for _, i in best} & {v for _, v, _ in mine}), total + 5
        assert all(abs(score[list(ids).index(v)] - s) < 1e-9 for _, v, s in mine)
    assert hit / total >= 0.9 and not {r["query_id"] for r in got} & {5000, 5050, 5100, 5150, 5200}
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1000] == [(1, 5), (2, 1001), (3, 1002), (4, 1003), (5, 1004)]
    assert ann.nearest(df.limit(0), F.col("id") % 50 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.nearest(two, F.col("id") == 0).collect()] == [(0, 1)]


def test_nearest_vectors_among_near_copies(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(8, 16)), 60, axis=0) + rng.normal(size=(480, 16)) * 1e-4
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, (x[7] * (3 + i)).tolist()) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(df, F.col("id") % 10 == 0).collect()}
    ids, unit = np.array([int(i) for i, _ in rows]), np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for q in ids[ids % 10 == 0]:
        score = np.round(unit @ unit[ids == q][0], 12)
        want |= {(q, k + 1): i for k, (_, i) in enumerate(sorted((-s, i) for s, i in zip(score, ids) if i != q)[:5])}
    assert got.keys() == want.keys()
    assert sum(got[key] == want[key] for key in want) >= 0.97 * len(want)
    assert [got[1000, k] for k in range(1, 6)] == [7, 1001, 1002, 1003, 1004]


def test_site_quality(spark, docs, empty):
    rng = random.Random(6)
    good = [(1000 + k, " ".join(rng.choice(WORDS) for _ in range(80)), f"h{k % 4}") for k in range(120)]
    bad = [(2000 + k, "### $$$ | x " * 30, f"h{k % 4}") for k in range(60)]
    df = table(spark, good + bad).unionByName(docs)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good[:80]] + [(i, 0, 0) for i, *_ in bad[:40]] + [(None, 1, 0), (9999, 0, 0), (1000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.score(df, labels, F.col("source"), F.col("lang")).collect()}
    assert all(got[i]["kept"] for i, *_ in good) and not any(got[i]["kept"] for i, *_ in bad)
    rates = [r["path_rate"] for r in got.values()]
    assert 0 < min(rates) and max(rates) < 1
    assert site_quality.score(empty, labels, F.col("source"), F.col("lang")).count() == 0
    none = site_quality.score(docs, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert len(none) == docs.count() and {r["score"] for r in none} == {0.5}


def held_out_lines():
    return pii.read_lines((Path(__file__).parent / "pii_held_out.txt").read_text("utf-8"))


def test_field_on_held_out_lines_of_documents(spark):
    """Lines labelled by hand that the training table doesn't hold."""
    lines = held_out_lines()
    assert not set(lines) & set(pii.labelled()) and len(lines) == 60
    right, total, found, marked = 0, 0, 0, 0
    for line in lines:
        data = " ".join(w for w, _ in line).encode()
        block = tb.Block(0, 1, np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        _, s, e = block.words()
        y = pii._field().decode(pii.shapes(block.data, s, e, np.arange(len(s)) == 0), np.array([len(s)]))
        gold = np.array([k for _, k in line])
        right, total = right + int((y == gold).sum()), total + len(line)
        found, marked = found + int(((y == gold) & (gold > 0)).sum()), marked + int((gold > 0).sum())
    assert right / total > 0.99 and found / marked > 0.97


def test_base_spans_against_plain_patterns(spark):
    """Texts drawn from the characters that matter, against the patterns as they are written down."""
    import re

    rng = random.Random(9)
    texts = ["".join(rng.choice("0123459.+- ()@ab_\n4é") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["4111111111111111 " * 3, "+49 (30) 1234-5678. x@a.b", "1.2.3.4.5 256.1.1.1 0001.2.3.4"]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, text):
        d = [int(c) for c in text if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in text.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    got = {r["doc_id"]: r for r in pii.detect(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = {k: [m.span() for m in re.finditer(p, t) if good(k, m[0])] for k, p in patterns.items()}
        text = ",".join(f"{k}:{a}:{b}" for k in patterns for a, b in want[k])
        assert [got[i][f"n_{k}"] for k in patterns] == [len(v) for v in want.values()] and got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))


def test_site_rates_and_scores_against_plain_arithmetic(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 60))), rng.choice(["a", "b", None, "d"])) for k in range(300)]
    docs = table(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in docs.collect()}
    y = {k: int(rng.random() < {"a": 0.9, "b": 0.2, None: 0.5, "d": 0.6}[site[k][0]]) for k in range(200)}
    labels = spark.createDataFrame([(k, v, 0) for k, v in y.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in site_quality.score(docs, labels, F.col("source"), F.col("lang")).collect()}

    def strength(groups, center):
        some = {g: v for g, v in groups.items() if len(v) >= 2}
        n = {g: len(v) for g, v in some.items()}
        spread = np.mean([center[g] * (1 - center[g]) for g in some])
        total = sum(n.values())
        ss = sum(n[g] * (np.mean(v) - center[g]) ** 2 for g, v in some.items())
        between = (ss - (len(some) - 1) * spread) / (total - sum(k * k for k in n.values()) / total)
        return min(1000.0, max(1.0, spread / between - 1)) if between > 0 else 1000.0

    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for k, v in y.items():
        hosts[site[k][0]].append(v)
        paths[site[k]].append(v)
    rate = np.mean(list(y.values()))
    s = strength(hosts, dict.fromkeys(hosts, rate))
    host_rate = {h: (sum(v) + s * rate) / (len(v) + s) for h, v in hosts.items()}
    t = strength(paths, {p: host_rate[p[0]] for p in paths})
    path_rate = {p: (sum(v) + t * host_rate[p[0]]) / (len(v) + t) for p, v in paths.items()}
    for k, r in got.items():
        p = path_rate.get(site[k], host_rate[site[k][0]])
        odds = r["evidence"] - np.log(rate / (1 - rate)) + np.log(p / (1 - p))
        assert np.isclose(r["host_rate"], host_rate[site[k][0]]) and np.isclose(r["path_rate"], p) and np.isclose(r["score"], 1 / (1 + np.exp(-odds)))


def test_site_quality_on_held_out_labels(spark):
    """Fitted on half of the labels of real documents, held against the other half."""
    data = Path("/root/testdata/sf0.01")
    if not data.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = site_quality.score(docs, labels.filter(half), F.col("source"), F.col("lang")).select("doc_id", "kept").join(labels.filter(~half & F.col("quality").isNotNull()), "doc_id").collect()
    assert len(got) > 100 and sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.95


def test_mix_takes_the_documents_with_the_smallest_keys(docs):
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17)), 11).cast("double") + 0.5) / float(1 << 53)
    one = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    keyed = one.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), (-F.log(u) / mixing.quality(F.col("text"))).alias("key")).collect()
    got = mixing.mix(one).collect()
    want = models.mix_repeats([tuple(r) for r in keyed], {r["source"]: r["target"] for r in got})
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["size"] * want[r["doc_id"]] for r in got}


def test_ids_with_several_texts_tie_their_groups(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    near = b.replace("b30 ", "x ")
    rows = [(3, a, "s"), (7, a, "s"), (7, b, "s"), (9, near, "s"), (11, "quite other words " * 9, "s")]
    got = supermin.near_duplicates(table(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(3, 3), (7, 3), (9, 3), (11, 11)} and len(got) == 5


def test_long_texts_are_hashed_in_bounded_pieces():
    import tracemalloc

    rng = np.random.default_rng(1)
    letters = rng.integers(97, 123, 6_000_000, dtype=np.uint8)
    letters[rng.random(len(letters)) < 0.17] = 32
    text = pa.array([letters.tobytes().decode()], pa.large_string())
    block = next(tb.blocks(text))
    row, start, end = block.words()
    tracemalloc.start()
    hashes = block.hash(start, end)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(letters)
    some = rng.integers(0, len(start), 300)
    for k in some:
        piece = next(tb.blocks(pa.array([letters[start[k] : end[k]].tobytes().decode()])))
        assert piece.hash(*piece.words()[1:])[0] == hashes[k]
