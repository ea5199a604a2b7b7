"""BPE, chat, repeats, toxicity, near-duplicates and WARC against plain versions."""

import gzip
import hashlib
import itertools
import json
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voicelake.llm import bpe, chat, components, neardup, suffixdedup, toxicity, warc
from voicelake.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_file())


def test_bpe_equals_the_library(edge, none, peer):
    texts = defaultdict(list)
    for r in edge.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in bpe.token_report(edge, bpe.vocabulary_file()).collect():
        found = []
        for text in texts[r["doc_id"]]:
            ids = peer.encode(text, add_special_tokens=False).ids
            back = peer.decode(ids, skip_special_tokens=False)
            found.append((len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert tuple(r)[1:] in found
    assert bpe.token_report(none, bpe.vocabulary_file()).count() == 0
    assert bpe.encode(edge, bpe.vocabulary_file()).count() == edge.count()


@pytest.mark.parametrize(
    "place, value",
    [
        (("normalizer",), {"type": "NFC"}),
        (("pre_tokenizer", "add_prefix_space"), True),
        (("pre_tokenizer", "use_regex"), False),
        (("pre_tokenizer",), {"type": "Whitespace"}),
        (("model", "ignore_merges"), True),
        (("added_tokens", 0, "lstrip"), True),
        (("model", "vocab"), {"a": 0}),
    ],
)
def test_bpe_refuses_other_settings(edge, tmp_path, place, value):
    spec = at = json.load(open(bpe.vocabulary_file(), encoding="utf-8"))
    for key in place[:-1]:
        at = at[key]
    at[place[-1]] = value
    (tmp_path / "other.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="not handled"):
        bpe.token_report(edge, str(tmp_path / "other.json"))


def test_bpe_random_strings(peer):
    own, rng = bpe.codec(open(bpe.vocabulary_file(), encoding="utf-8").read()), random.Random(5)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\x85", " ", "é", "日本", "😀", "1", "²", "!", "'s", "<|endoftext|>", "ing", "\x00", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert list(memoryview(own.encode(text)).cast("I")) == peer.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text


def repeats(texts):
    where = Counter()
    for b in texts:
        where.update(b[p : p + 200] for p in range(len(b) - 199))
    out = []
    for b in texts:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 199):
            if where[b[p : p + 200]] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        mark = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        out.append((len(b), int(mark.sum()), int((np.diff(np.concatenate(([0], mark.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(edge, none):
    rows = edge.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, repeats([(r["text"] or "").encode() for r in rows]), strict=True))
    assert Counter(map(tuple, suffixdedup.repeat_report(edge).collect())) == want
    named = edge.withColumns({"cut_text": F.lit("own"), "uid": F.lit(1), "_cut_id": F.lit("x")})
    cut = suffixdedup.cut_repeats(named)
    assert cut.columns == named.columns and {(r["cut_text"], r["uid"], r["_cut_id"]) for r in cut.collect()} == {("own", 1, "x")}
    cut = suffixdedup.cut_repeats(edge)
    assert cut.columns == edge.columns and cut.count() <= len(rows)
    assert suffixdedup.repeat_report(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_repeats_random_overlaps(spark, seed):
    """Small alphabets, periodic texts and overlapping pieces of a common source."""
    rng = random.Random(seed)
    source = "".join(rng.choice("ab") for _ in range(3000))
    texts = ["".join(source[s : s + rng.randint(100, 420)] for s in (rng.randint(0, 2500) for _ in range(rng.randint(1, 4)))) for _ in range(60)]
    texts += ["ab" * 300, "ab" * 99, "a" * 199, "a" * 200, "a" * 201, "é" * 150]
    got = suffixdedup.repeat_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [tuple(r)[1:] for r in sorted(got)] == repeats([t.encode() for t in texts])


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def near(rows):
    """Brute force over all pairs."""
    sets, parent = defaultdict(list), {}
    for i, t in rows:
        sets[i].append(shingles(t))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations([i for i in sets if i is not None], 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            one, two = find(a), find(b)
            parent[max(one, two)] = min(one, two)
    return {i: find(i) for i in sets if i is not None}


def test_near_duplicates(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    want = near(rows)
    got = neardup.near_duplicates(edge).collect()
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter((i, len(shingles(t))) for i, t in rows)
    for r in got:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) and r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    left = neardup.drop_near_duplicates(edge)
    assert left.columns == edge.columns and left.count() == sum(r["kept"] for r in got)
    assert neardup.near_duplicates(none).count() == 0


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c), (8, "d e f"), (9, c), (10, ""), (10, a + " more"), (None, b)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (5, 3, False), (7, 3, False), (8, 8, True), (9, 8, False), (10, 3, False), (None, None, True)}


def test_hot_copies_and_bands(spark, monkeypatch):
    """Copies and bands over the hot limit take the broadcast way and give the same rows."""
    from voicelake.llm import scratch

    monkeypatch.setattr(scratch, "HOT_LEAST", 5)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base)) for i in range(40)] + [(100 + i, " ".join(base[: 195 + i % 5] + [f"x{rng.randint(0, 99)}"])) for i in range(40)] + [(500 + i, f"own text {i} of its own") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near(rows)


def test_long_words_are_told_apart(spark):
    """A Thue-Morse word and its complement, whose sums modulo 2 ** 64 are equal."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word + " tail"), (2, word.translate(str.maketrans("ab", "ba")) + " tail")]
    assert {r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_near_duplicate_family(spark):
    """A large family of edited copies around the limit, in several blocks."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in rng.sample(range(120), rng.choice([2, 5, 8, 11, 14])):
            words[k] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    size, neardup.BLOCK = neardup.BLOCK, (6000, 6000)
    try:
        got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        neardup.BLOCK = size
    assert got == near(rows)


def test_odd_sketch_estimates(spark):
    a = [f"w{k}" for k in range(400)]
    b = [w if k % 40 else "other" + w for k, w in enumerate(a)]
    one, two = (neardup.odd_sketch(neardup.samples(neardup.shingle_set(" ".join(x)))) for x in (a, b))
    bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in one ^ two)
    assert bits < neardup.most_bits(neardup.LEAST_ESTIMATE)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "one long, two long"), Scratch(spark, "t"), "t").collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[a] == got[b] for a, b in links if a != b)


def test_preferences(spark):
    chosen = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (2, 0, "user", "a"), (3, 0, "user", None), (None, 0, "user", "n")]
    rejected = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad😀"), (1, 3, "user", "why"), (2, 0, "user", "a"), (3, 0, "user", "x")]
    make = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, turn long, role string, text string, prompt int")
    got = {r["pair_id"]: r for r in chat.format_preferences(make(chosen), make(rejected)).collect()}
    one = got[1]
    assert one["n_shared"] == 2 and one["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_spans"]] == ["good<|im_end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_spans"]] == ["bad😀<|im_end|>\n"]
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_shared"] == 1
    assert got[3]["n_shared"] == 0 and got[None]["rejected"] == ""
    assert chat.format_preferences(make([]), make([])).count() == 0


def plain_pairs(rows):
    """Chosen and rejected turns of every conversation, in plain Python."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(g)] for c, g in groups.items()}
    at = {c: max((k for k, t in enumerate(g) if t[0] == "assistant"), default=None) for c, g in convs.items()}
    order = sorted((c for c in convs if at[c] is not None), key=lambda c: (c is None, c or 0))
    out = {}
    for c, g in convs.items():
        swapped = list(g)
        if at[c] is not None:
            other = order[(order.index(c) + 1) % len(order)]
            swapped[at[c]] = ("assistant", convs[other][at[other]][1] if len(order) > 1 else "")
        shared = next((k for k in range(len(g)) if g[k] != swapped[k]), len(g))
        render = lambda turns: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)
        masked = lambda turns: [t + "<|im_end|>\n" for r, t in turns if r == "assistant"]
        out[c] = (shared, render(g[:shared]), render(g[shared:]), render(swapped[shared:]), masked(g[shared:]), masked(swapped[shared:]))
    return out


def test_pairs_of_all_conversations(spark):
    """Ids far apart, no replies, turns after the last reply, null ids and numbers, ties, repeated rows and a very long text."""
    rows = [(i * 1000, k, role, f"{role} {i} {k}") for i in range(-3, 9) for k, role in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: 2 + (i + 3) % 5])]
    rows += [(None, 0, "user", "n"), (None, 1, "assistant", "null"), (5, None, "assistant", "late"), (5, None, None, None), (5, 3, "assistant", "tie b"), (5, 3, "assistant", "tie a"), (5, 3, "assistant", "tie b")]
    rows += [(2**62, 0, "assistant", "long " * 60_000), (77, 0, "user", "alone")]
    schema = "conv_id long, turn long, role string, text string, c string, r string, at int, other string, pair_id int"
    got = chat.formatted(chat.with_swapped_reply(spark.createDataFrame([(*r, "x", "x", 1, "x", 2) for r in rows], schema))).collect()
    cut = lambda r, side: [r[side][s["start"] : s["end"]] for s in r[f"{side}_spans"]]
    assert {r["pair_id"]: (r["n_shared"], r["prompt"], r["chosen"], r["rejected"], cut(r, "chosen"), cut(r, "rejected")) for r in got} == plain_pairs(rows)
    single = chat.formatted(chat.with_swapped_reply(spark.createDataFrame([(1, 0, "assistant", "a"), (2, 0, "user", "b")], "conv_id long, turn long, role string, text string"))).collect()
    assert {r["pair_id"]: cut(r, "rejected") for r in single} == {1: ["<|im_end|>\n"], 2: []}


def test_ordinal_fit_recovers_grades():
    rng = np.random.RandomState(0)
    truth, theta = rng.randn(30), np.array([-0.5, 1.0, 2.5])
    rows = [sorted(rng.choice(30, rng.randint(1, 8), replace=False).tolist()) for _ in range(4000)]
    score = np.array([truth[r].sum() for r in rows]) + rng.logistic(size=4000)
    weights, found = toxicity.fit(rows, (score[:, None] > theta).sum(axis=1).tolist(), 30, 4)
    assert np.corrcoef(weights, truth)[0, 1] > 0.97 and (np.diff(found) > 0).all() and np.abs(found - theta).max() < 0.4


def test_toxicity(spark, none, labels):
    rng = random.Random(0)
    words, bad = [f"w{k}" for k in range(100)], ["vilest", "scummy"]
    rows, marks = [], []
    for i in range(800):
        level = 0 if i % 4 else 1
        text = " ".join(rng.choice(words) for _ in range(40)) + (" " + rng.choice(bad) if level else "")
        rows.append((i, text))
        marks.append((i, 1, level))
    docs = spark.createDataFrame([*rows, (None, None), (9000, "")], "doc_id long, text string")
    got = toxicity.toxicity_report(docs, spark.createDataFrame([m for m in marks if m[0] < 500], "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["doc_id"] is not None and 500 <= r["doc_id"] < 800]
    assert sum(r["toxic"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.98
    assert len(got) == 802
    assert toxicity.toxicity_report(docs, labels.limit(0)).filter("toxic").count() == 0
    assert toxicity.toxicity_report(none.select("doc_id", "text"), labels).count() == 0


def test_severity_of_every_row(spark, edge):
    """Expected severity recomputed in plain Python from the fitted model; repeated ids and clashing columns neither fail nor multiply the sample."""
    import regex

    rng = random.Random(9)
    bad = ["vilest", "scummy", "rottenest"]
    rows = [(i, " ".join(rng.choice("one two three four five six".split()) for _ in range(20)) + f" {rng.choice(bad)}" * (i % 3)) for i in range(300)]
    rows += [(5, rows[5][1])] * 5000 + [(None, None), (400, "")]
    docs = spark.createDataFrame([(*r, 1, "f", 2.0) for r in rows], "doc_id long, text string, grade int, features string, expected_severity double")
    graded = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(7, 0), (None, 2), (8, None)], "doc_id long, grade int")
    model = toxicity.train(docs, graded)
    assert model == toxicity.train(docs.dropDuplicates(["doc_id"]), graded)
    weights, theta = model["weights"], np.array(model["thresholds"])
    want = Counter()
    for i, text in rows:
        own = {f for w in set(regex.findall(r"\w+", (text or "").lower())) for f in toxicity.word_features(w) if f in weights}
        above = 1 / (1 + np.exp(theta - sum(weights[f] for f in sorted(own))))
        want[i, round(float(above.sum()), 9), int((above >= 0.5).sum())] += 1
    got = toxicity.score(docs, model).collect()
    assert Counter((r["doc_id"], round(r["expected_severity"], 9), r["grade"]) for r in got) == want
    assert {r["grade"] for r in got} == {0, 1, 2}


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/?x", '<title>T &amp; U</title><script>x<p></script><p>Hi <b>there</b>&lt;</p><!-- c --><a href="/l">L</a>'), (2, None, None)], "page_id long, url string, html string")
    rows = {(r["page_id"], r["kind"]): r for r in warc.derivatives(warc.responses(pages)).collect()}
    assert rows[1, "conversion"]["block"] == "T & U\nHi there<\nL" and "outlink: /l" in rows[1, "metadata"]["block"]
    assert rows[1, "conversion"]["refers_to"] == rows[1, "metadata"]["refers_to"] != rows[1, "conversion"]["record_id"]
    assert rows[1, "metadata"]["block_digest"] == "sha256:" + hashlib.sha256(rows[1, "metadata"]["block"].encode()).hexdigest()
    assert rows[2, "conversion"]["block"] == ""
    derived = warc.derivatives(warc.responses(pages.unionByName(pages.limit(1))))
    warc.write_warc(derived, str(tmp_path / "w"))
    found = Counter()
    for part in (tmp_path / "w").glob("part-*/records.warc.gz"):
        data, index = part.read_bytes(), [json.loads(x) for x in (part.parent / "records.idx").read_text().splitlines()]
        assert [x["offset"] for x in index] == [0, *itertools.accumulate(x["length"] for x in index)][:-1] and sum(x["length"] for x in index) == len(data)
        for entry in index:  # each record is a member of its own
            member = gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])
            head, rest = member.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines[1:] if not x.startswith("WARC-Source-Header"))
            sent = [x.split(": ", 1)[1] for x in lines if x.startswith("WARC-Source-Header")]
            size = int(fields["Content-Length"])
            assert lines[0] == "WARC/1.0" and sent[:2] == ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"] and rest[size : size + 4] == b"\r\n\r\n"
            assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(rest[:size]).hexdigest()
            found[fields["WARC-Record-ID"], fields["WARC-Refers-To"], rest[:size].decode()] += 1
            assert len(rest) == size + 4 and entry["record_id"] == fields["WARC-Record-ID"]
    assert found == Counter((r["record_id"], r["refers_to"], r["block"]) for r in derived.collect())
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
    long = "<p>" + "word &amp; " * 50_000
    own = spark.createDataFrame([(1, "u", long, "2024-05-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX: y\r\n\r\n", "b", "k"), (1, "u", long, None, None, "b", "k")], "page_id long, url string, html string, date string, headers string, block string, kind string")
    rows = warc.derivatives(warc.responses(own)).collect()
    assert {(r["made_up"], r["date"]) for r in rows} == {(False, "2024-05-01T00:00:00Z"), (True, warc.UNDATED)}
    assert {r["block_bytes"] for r in rows if r["kind"] == "conversion"} == {len("word & ") * 50_000 - 1}


def test_captures_of_one_page_and_forged_headers(spark, tmp_path):
    url = "http://a/\r\nWARC-Type: response\r\n\r\nx"
    rows = [(1, url, "<p>one", "2024-05-01T00:00:00Z", "A: b\r\n\r\n"), (1, url, "<p>one", "2024-05-02T00:00:00Z", "A: b\rWARC-Type: c\r\n\r\n"), (1, url, "<p>two", "2024-05-01T00:00:00Z\nX: y", None)]
    derived = warc.derivatives(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string, date string, headers string")))
    got = derived.collect()
    assert len({r["record_id"] for r in got}) == 6 and len({r["refers_to"] for r in got}) == 3
    warc.write_warc(derived, str(tmp_path / "w"))
    with pytest.raises(FileExistsError):
        warc.write_warc(derived, str(tmp_path / "w"))
    for part in (tmp_path / "w").glob("part-*/records.warc.gz"):
        text = gzip.decompress(part.read_bytes()).decode()
        assert len(re.findall(r"^WARC-Type: ", text, re.M)) == text.count("WARC/1.0\r\n") and "\nX: y" not in text
