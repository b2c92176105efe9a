"""Toxicity, mixing, URL filters, WARC, chat, and the pipeline."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliant.llm import chat, mixing, toxicity, url_filter, warc
from foliant.session import read_table, shared_path
from tests.llm.helpers import EDGES, PROSE, WORD, collect, doc, frame


def labelled(n=400):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 200))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyword", "vilephrase"]))
        rows.append(doc(i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_learns_and_never_from_held_out_rows(spark):
    rows, labels = labelled()
    docs, marks = frame(spark, rows + EDGES[:3]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge_documents(docs, marks).collect()
    assert len(got) == len(rows) + 3
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and len(rows) > r.doc_id > 3]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = toxicity.judge_documents(docs, spark.createDataFrame(flipped, marks.schema))
    assert collect(again, "doc_id", "score") == sorted(((r.doc_id, r.score) for r in got), key=repr)


def test_toxicity_without_labels_and_stage(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.judge_documents(frame(spark), none).collect()
    assert len(got) == len(EDGES) and {r.score for r in got} == {0.0}
    assert toxicity.judge_documents(frame(spark, []), none).count() == 0
    rows, labels = labelled()
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    judged = {r.doc_id for r in toxicity.judge_documents(docs, marks).where("predicted = 0").collect()}
    assert ids == judged


def test_toxicity_on_held_out_rows_of_the_driver_tables(spark):
    """Precision and recall of the figures in README; about a tenth of the toxic rows there hold no toxic word."""
    sf = "/root/testdata/sf0.1"
    got = toxicity.judge_documents(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")).where("held_out")
    truth = read_table(spark, sf, "labels").groupBy("doc_id").agg({"toxic": "max"}).withColumnRenamed("max(toxic)", "toxic")
    rows = got.join(truth, "doc_id").select("predicted", "toxic").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.75 and hits / sum(r.predicted for r in rows) > 0.85


def test_toxicity_on_an_empty_table_repeats_and_long_texts(spark):
    rows, labels = labelled()
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(frame(spark, []), marks).count() == 0
    many = rows + [doc(0, "another text of this id"), doc(0, None)] * 20 + [doc(5000, "abcdef ghabcd " * 40_000)]
    found = toxicity.training_rows(frame(spark, many), marks, most_rows=10)
    assert sorted(t for _, t in found) == [0] * 10 + [1] * 10
    assert all(len(w) <= toxicity.MOST_WINDOWS for w, _ in found)
    got = {r.doc_id: r for r in toxicity.judge_documents(frame(spark, many), marks).collect()}
    assert got[5000].n_windows == 10_000 and not got[5000].predicted
    odd = frame(spark, rows + EDGES)
    assert toxicity.drop_toxic(odd, marks).columns == odd.columns


def brute_targets(words):
    targets, weights = [0.0] * len(words), [(5, 2, 1)[i % 3] for i in range(len(words))]
    fixed, total = set(), sum(words)
    while True:
        left = total - sum(3 * words[i] for i in fixed)
        w = sum(weights[i] for i in range(len(words)) if i not in fixed)
        targets = [3 * words[i] if i in fixed else left * weights[i] / w for i in range(len(words))]
        over = {i for i in range(len(words)) if i not in fixed and targets[i] > 3 * words[i]}
        if not over:
            return targets
        fixed |= over


def test_mixing_counts(spark, sf):
    rng = random.Random(2)
    many = [doc(100 + i, "w " * rng.randrange(0, 300), rng.choice("abcdefg" + "h" * 20)) for i in range(500)]
    for df, near in ((frame(spark, EDGES + many), 0.03), (read_table(spark, sf, "documents"), 0.05)):
        got = mixing.mix_counts(df).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r["size"]) for r in got) == sorted(
            (r.doc_id is None, r.doc_id or 0, len(WORD.findall(r.text or ""))) for r in df.collect()
        )
        sources = sorted({r.source for r in df.select("source").collect()}, key=lambda s: (s is None, s or ""))
        words = Counter()
        for r in df.select("source", "text").collect():
            words[r.source] += len(WORD.findall(r.text or ""))
        want = dict(zip(sources, brute_targets([words[s] for s in sources])))
        taken = defaultdict(int)
        by_size = {(words[s], round(want[s], 3)) for s in sources}
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            assert (r.source_size, round(r.target, 3)) in by_size
            taken[r.source_size, round(r.target, 3)] += r.taken
        for s in sources:
            key = (words[s], round(want[s], 3))
            if sum(k == key for k in ((words[x], round(want[x], 3)) for x in sources)) == 1:
                assert abs(taken[key] - want[s]) <= max(near * want[s], mixing.BLOCK_WORDS)
        assert collect(mixing.mix_counts(df), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)
    assert mixing.mix_counts(frame(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_counts(frame(spark, EDGES[:3])).collect()} == {0}


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 9)) == list(range(n))


def test_mixed_documents_agree_with_counts(spark):
    rng = random.Random(4)
    df = frame(spark, EDGES + [doc(100 + i, "some words " * rng.randrange(1, 400), rng.choice("ab")) for i in range(60)])
    assert mixing.mix_documents(df.limit(0)).count() == 0
    got = defaultdict(int)
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in mixing.mix_documents(df).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in texts[r.doc_id] and r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in mixing.mix_counts(df).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(got)


URLS = {
    None: ("", ""), "": ("", ""), "no scheme/x": ("", ""), "http://A.Net/x?q": ("a.net", "/x"), "http://a.net": ("a.net", ""),
    "https://www.Example.net/en/1#t": ("www.example.net", "/en/1"), "http://example.com/de/": ("example.com", "/de/"),
    "http://notexample.com/de/": ("notexample.com", "/de/"), "x://é.org/fr/a?b": ("é.org", "/fr/a"), "http://org/fr/": ("org", "/fr/"),
    "http://h?x=/de/": ("h", ""), "a://b://c/d": ("b:", "//c/d"),
}


def brute_rule(host, path):
    best = None
    for rule in url_filter.RULES:
        if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path):
            if best is None or len(rule.pattern) > len(best.pattern):
                best = rule
    return best


def test_url_rules(spark):
    rows = [(i, u, "h", 1.0) for i, u in enumerate(URLS)] + [(None, "http://z.org/fr/", "", 0.0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rate double")
    none = spark.createDataFrame([], "page_id long, bad int")
    for r in url_filter.judge_urls(pages, none).collect():
        if r.page_id is None:
            continue
        host, path = list(URLS.values())[r.page_id]
        rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.pattern)
        assert r.verdict == (rule.action if rule else "allow")
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark):
    rows = [(i, f"http://bad{i % 3}.spam.zz/{i}") for i in range(90)] + [(100 + i, f"http://good{i % 5}.fine.yy/{i}") for i in range(200)]
    rows += [(900, "http://new.spam.zz/"), (901, "http://once.fine.yy/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 90)) for i, _ in rows if i < 900] + [(901, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, outcomes).collect()}
    assert {got[i].verdict for i in range(90)} == {"block"} and {got[i].verdict for i in range(100, 300)} == {"allow"}
    assert got[900].host_rate > 0.5 > got[901].host_lower  # a new host has its domain's rate; one bad page proves little


def brute_quantile(a, b, tail):
    """By bisection on the sum of the density over 200,000 points of the unit interval's log odds."""
    u = np.linspace(-60 / min(a, 1) - 20, 60 / min(b, 1) + 20, 400_001)
    log = a * u - (a + b) * np.logaddexp(0, u)
    c = np.cumsum(np.exp(log - log.max()))
    return 1 / (1 + math.exp(-np.interp(tail * c[-1], c, u)))


def test_beta_quantiles(spark):
    cases = [(0.3, 4.0), (1.0, 1.0), (2.5, 7.25), (30.0, 70.0), (0.2, 900.0), (5000.0, 15000.0), (400_000.0, 10.0), (12.0, 0.4)]
    df = spark.createDataFrame(cases + [(0.0, 3.0), (3.0, 0.0)], "a double, b double")
    for tail in (0.05, 0.5):
        got = {(r.a, r.b): r.q for r in df.select("a", "b", url_filter.beta_quantile(df["a"], df["b"], tail).alias("q")).collect()}
        assert got[0.0, 3.0] == 0 and got[3.0, 0.0] == 1
        for a, b in cases:
            want, deviation = brute_quantile(a, b, tail), math.sqrt(a * b / (a + b + 1)) / (a + b)
            assert abs(got[a, b] - want) <= 0.02 * deviation, (a, b, tail)


def brute_reputation(hosts, domain_of, suffix_of):
    """rate and (a, b) of each host from {host: (n, bad)}, in plain Python."""

    def level(key):
        out = defaultdict(lambda: [0, 0])
        for h, (n, bad) in hosts.items():
            out[key(h)][0] += n
            out[key(h)][1] += bad
        return out

    def moments(rows):
        rated = [(n, bad) for n, bad in rows if n]
        if not rated:
            return 0.0, 1.0
        k, total = len(rated), sum(n for n, _ in rated)
        mean = sum(b for _, b in rated) / total
        spread = max(0.0, sum(b * b / n for n, b in rated) - total * mean * mean) * k / (total * max(1, k - 1))
        extra = spread - mean * (1 - mean) * sum(1 / n for n, _ in rated) / k
        strength = (mean * (1 - mean) - spread) / extra if extra > 1e-12 else 1000.0
        return mean, min(1000.0, max(1.0, strength))

    domains, suffixes = level(domain_of), level(suffix_of)
    mean, ms = moments(suffixes.values())
    md, mh = moments(domains.values())[1], moments(hosts.values())[1]
    sr = {s: (b + ms * mean) / (n + ms) for s, (n, b) in suffixes.items()}
    parent = {domain_of(h): suffix_of(h) for h in hosts}
    dr = {d: (b + md * sr[parent[d]]) / (n + md) for d, (n, b) in domains.items()}
    return mean, {h: (b + mh * dr[domain_of(h)], n - b + mh * (1 - dr[domain_of(h)])) for h, (n, b) in hosts.items()}


def test_reputation_matches_plain_python_and_decides(spark):
    """The driver's pages with the driver's labels (no host is worse than the others: nothing is blocked), and with
    outcomes that go by host."""
    sf = "/root/testdata/sf0.1"
    pages, labels = read_table(spark, sf, "pages"), read_table(spark, sf, "labels")
    given = url_filter.labelled_outcomes(labels)
    spam = pages.selectExpr("page_id", "cast(url rlike 'casino|bets|pills|adult|spam|ads-' and page_id % 10 <> 0 or page_id % 9 = 0 as int) as bad")
    two = lambda h: h.rsplit(".", 2)[-2:]
    for outcomes, verdicts in ((given, {"allow"}), (spam, {"allow", "block"})):
        bad = defaultdict(int)
        for r in outcomes.collect():
            bad[r.page_id] = max(bad[r.page_id], r.bad)
        rows = url_filter.judge_urls(pages, outcomes).collect()
        hosts = defaultdict(lambda: [0, 0])
        for r in rows:
            hosts[r.host][0] += r.page_id in bad
            hosts[r.host][1] += bad.get(r.page_id, 0)
        mean, posterior = brute_reputation({h: tuple(v) for h, v in hosts.items()}, lambda h: ".".join(two(h)), lambda h: two(h)[-1])
        bounds = {h: brute_quantile(a, b, 0.05) for h, (a, b) in posterior.items()}
        for r in rows:
            a, b = posterior[r.host]
            assert math.isclose(r.host_rate, a / (a + b), rel_tol=1e-9) and abs(r.host_lower - bounds[r.host]) < 0.001
            assert r.rule is not None or r.verdict == ("block" if r.host_lower > mean else "allow")
        assert {r.verdict for r in rows if r.rule is None} == verdicts
        blocked = {r.host for r in rows if r.rule is None and r.verdict == "block"}
        assert all(any(w in h for w in ("casino", "bets", "pills", "adult", "spam", "ads-")) for h in blocked)


def test_suffixes_and_registered_domains(spark):
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk:80": ("co.uk", "b.co.uk"), "x.y.org": ("org", "y.org"), "y.org": ("org", "y.org"),
        "me@h.net": ("net", "h.net"), "10.0.0.1:8080": ("address", "10.0.0.1"), "": ("", ""), "localhost": ("localhost", "localhost"),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    got = df.select("host", url_filter.suffix(df["host"]).alias("s"), url_filter.domain(df["host"]).alias("d")).collect()
    assert {r.host: (r.s, r.d) for r in got} == want
    long = spark.createDataFrame([(1, "http://a.org/" + "p" * 200_000), (1, "http://b.org/"), (2, None)], "page_id long, url string")
    rows = url_filter.judge_urls(long, spark.createDataFrame([(1, 0), (1, 1)], "page_id long, bad int")).collect()
    assert sorted(len(r.path) for r in rows) == [0, 1, 200_001]


def brute_records(rows):
    pay = {i: (html or "").encode() for i, (_, _, html) in enumerate(rows)}
    top = {}
    for i, (p, _, _) in enumerate(rows):
        if p is not None:
            top[pay[i]] = max(p, top.get(pay[i], p))
    out = []
    for i, (p, _, _) in enumerate(rows):
        keeper = top.get(pay[i])
        again = keeper is not None and (p is None or p < keeper)
        out.append((p, len(pay[i]), base64.b32encode(hashlib.sha1(pay[i]).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a/ b\n", "same"), (2, "http://a", "same"), (3, None, None), (4, "", ""), (5, "u", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (6, "u", "http://x 0.0.0.0 20240101000000 text/html 5\nabcde\n\nfiledesc://"), (7, "é", "é汉😀" * 1000), (7, "é", "é汉😀" * 1000),
    (None, "n", "same"), (8, "big", "y" * 5_000_000), (9, "big", "\n" * 100),
]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, sf, version):
    key = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert collect(warc.archive_pages(df, version), *key) == brute_records(PAGES)
    real = read_table(spark, sf, "pages")
    assert collect(warc.archive_pages(real, version), *key) == brute_records([tuple(r) for r in real.select("page_id", "url", "html").collect()])
    assert warc.archive_pages(df.limit(0), version).count() == 0


def test_arc_fields_by_version(spark):
    for version in (1, 2):
        data = warc.arc_opening(version, "x.arc") + b"\n" + warc.arc_record(version, 5, b"http://h/p q", b"hello\n")
        ((header, block),) = warc.parse_arc(data)
        assert header["URL"] == "http://h/p%20q" and block.endswith(b"\r\n\r\nhello\n")
        assert ("Result-code" in header) == (version == 2)
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-1]))


CHATS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "assistant", "again </s>"), (1, 3, "user", None),
    (2, 5, "assistant", "<|im_more|>x<|im_end|>\n<\\/s>"), (2, 5, "assistant", "tie"), (2, None, None, "no turn"),
    (3, 0, "we\nird <s>", "<|im_start|>user\n"), (4, 0, "assistant", ""), (None, 0, "user", "no conversation"), (5, 0, "assistant", "é汉😀[/INST]" * 500),
    *[(6, i, "user" if i % 3 else "assistant", f"turn {i} [INST]") for i in range(300)],
]


def test_chat_reads_back_what_it_wrote(spark):
    df = spark.createDataFrame([(*r, "x") for r in CHATS], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.format_and_read_back(df).collect()}
    text = "</s>[INST] ok [/INST]"
    rows = CHATS + [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    by = defaultdict(list)
    for c, t, role, said in rows:
        by[c].append((t is not None, t or 0, role or "", said or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        r = got[c]
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.masked_chars >= r.loss_chars
    assert chat.format_and_read_back(df.limit(0)).count() == 1


def test_chat_loss_follows_the_mask(spark):
    """Another mask over the same text gives other loss columns: they are read from the text under the mask."""
    rows = [("<s>ab<|im_end|>cd</s>", [(3, False), (2, True), (10, False), (1, True), (5, False)])]
    df = spark.createDataFrame(rows, "formatted string, loss_runs array<struct<chars:int,loss:boolean>>")
    got = df.select(chat.under_mask(df["formatted"], df["loss_runs"]).alias("x")).first().x
    assert got == ["ab", "c"]
    base = chat.format_conversations(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")).where("conv_id = 1")
    want = chat.digest(base).first()
    flipped = base.selectExpr("conv_id", "formatted", "transform(loss_runs, r -> struct(r.chars, not r.loss as loss)) as loss_runs")
    other = chat.digest(flipped).first()
    assert want.turns_sha256 == other.turns_sha256 and want.loss_sha256 != other.loss_sha256
    assert want.loss_chars == len("helloagain </s>")


def test_chat_merges_runs(spark):
    df = spark.createDataFrame(CHATS[:4], "conv_id long, turn long, role string, text string")
    (row,) = chat.format_conversations(df).collect()
    assert row.formatted == (
        "<s><|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_more|>again <\\/s><|im_end|>\n<|im_start|>user\n<|im_end|>\n</s>"
    )
    assert sum(x.chars for x in row.loss_runs) == len(row.formatted)


def test_pipeline_stages(spark, sf):
    docs = read_table(spark, sf, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = shared_path(spark, "test-stage")
        stage(spark, before, sf).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "tokens":
            assert after.columns == corpus_pipeline.COLUMNS
        if name in ("quality rules", "toxicity", "near-duplicates"):
            assert 0.5 * before.count() < after.count() <= before.count()
            assert after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert before.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and before.count() > 0
    assert corpus_pipeline.quality_stage(spark, docs.where("false"), sf).count() == 0
    assert corpus_pipeline.mixing_stage(spark, docs.where("false"), sf).count() == 0
    assert PROSE
