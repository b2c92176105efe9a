"""Each stage of the pipeline against plain Python over what the stage before it kept."""

import itertools

import pytest
import public_tokenizers
import tiktoken

import corpus_pipeline
from foliant.llm import bpe, quality
from foliant.llm.queries import RANKS
from foliant.session import materialize, read_table
from tests.llm.helpers import EDGES, WORD, frame
from tests.llm.test_text_operators import brute_quality

STOPS = {w for words in quality.STOP_WORDS.values() for w in words}


def brute_kept(text):
    """Length, symbols, exclamation marks, stop words and repeated lines in hundredths, beside the base rules."""
    n, chars, symbols, repeated_lines, _, failed = brute_quality(text)
    words = WORD.findall(text or "")
    lines = sum(1 for line in (text or "").split("\n") if WORD.search(line))
    stops = sum(w.lower().rstrip("!.,;:?%&$#*|") in STOPS for w in words)
    ratios = 200 * n <= 100 * chars <= 1600 * n and 100 * symbols <= 20 * n and 100 * (text or "").count("!") <= 30 * n
    return not failed and ratios and 100 * stops >= 2 * n and 100 * repeated_lines <= 40 * lines


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_survivors(docs):
    """The smallest doc_id of each component of texts with a similarity of 0.8 or more; texts without words are alike."""
    sets = {i: shingles(t) for i, t in docs}
    first: dict[frozenset, int] = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    holders: dict[tuple, list[int]] = {}
    root = {i: i for i in first.values()}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    common: dict[tuple[int, int], int] = {}
    for i in sorted(root):
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                common[j, i] = common.get((j, i), 0) + 1
            holders[s].append(i)
    for (j, i), both in common.items():
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted(i for i in root if find(i) == i)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_quality_verdicts_match_plain_python(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    for df in (docs, frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = dict(pairs(df))
        got = {r["doc_id"]: r["kept"] for r in quality.quality_report(df).collect()}
        assert got == {i: brute_kept(t) for i, t in texts.items()}
    assert len(set(got.values())) == 2


def test_near_duplicates_of_a_whole_table_match_all_pairs(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "/root/testdata/sf0.01")
    assert sorted(i for i, _ in pairs(kept)) == brute_survivors(pairs(docs))


def test_every_stage_works_on_what_the_one_before_kept(spark, sf):
    docs = read_table(spark, sf, "documents")
    stages = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stages.append(materialize(stage(spark, stages[-1], sf), "test-" + name.replace(" ", "-")))
    given, good, clean, single, mixed, tokens = stages
    for df in (good, clean, single, mixed):
        assert df.columns == corpus_pipeline.COLUMNS
    assert sorted(pairs(good)) == sorted((i, t) for i, t in pairs(given) if brute_kept(t))
    assert set(pairs(clean)) <= set(pairs(good)) and clean.count() >= 0.9 * good.count()
    toxic = {r["doc_id"] for r in read_table(spark, sf, "labels").where("toxic = 1").collect()}
    before, after = ({i for i, _ in pairs(df)} & toxic for df in (good, clean))
    assert len(after) < len(before)  # some toxic document goes
    assert sorted(i for i, _ in pairs(single)) == brute_survivors(pairs(clean))
    texts = dict(pairs(single))
    for i, t in pairs(mixed):  # a row is a stretch of the words of a document
        assert WORD.findall(t) and " ".join(WORD.findall(t)) in " ".join(WORD.findall(texts[i]))
    sources = {r["doc_id"]: r["source"] for r in single.collect()}
    names = sorted(set(sources.values()), key=lambda s: (s is None, s or ""))
    size = {s: sum(len(WORD.findall(texts[i])) for i in texts if sources[i] == s) for s in names}
    taken = {s: 0 for s in names}
    for i, t in pairs(mixed):
        taken[sources[i]] += len(WORD.findall(t))
    assert all(abs(taken[s] - goal) <= max(300, 0.03 * goal) for s, goal in targets(size).items())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(RANKS)), special_tokens={})
    assert sorted((r["doc_id"], r["n_tokens"]) for r in tokens.collect()) == sorted((i, len(library.encode_ordinary(t))) for i, t in pairs(mixed))


def targets(size):
    """Shares of all words by the weights 5, 2, 1; none over three times its source's, the excess shared again."""
    weights = dict(zip(size, itertools.cycle((5, 2, 1))))
    goal, left, open_ = {}, sum(size.values()), dict(weights)
    while open_:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return goal | share
        for s in over:
            goal[s] = 3 * size[s]
            left -= goal[s]
            del open_[s]
    return goal


def test_a_pipeline_over_edge_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, blank and very long texts, columns whose names clash; empty tables."""
    out = f"file://{tmp_path}"
    rows = [r for r in EDGES if r[0] is not None] + [(20 + i, f"The cat number {i} sat on the mat and it was for the dog that is in the sun " * 3, None, None, None, None, None) for i in range(12)]
    rows += [(None, None, None, None, None, None, None), (20, "The other text of this id is here and it is not that of the first one at all but for a word in it", "en", "s", 1, 0.5, "x")]
    frame(spark, rows).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(21, 1, 0), (22, 0, 1), (None, None, None), (23, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    got = corpus_pipeline.run(spark, out)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() >= 1
    frame(spark, []).write.parquet(f"{out}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{out}/none").count() == 0
