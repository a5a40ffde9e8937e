"""The pipeline against plain versions of its stages on a small corpus."""
import random
from collections import Counter

import pytest
from conftest import make_docs, prose
from pyspark.sql import functions as F
from test_lines import brute as brute_lines
from test_mixing import brute_targets
from test_simhash import fingerprint, groups, near_pairs
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.queries import WORD_TOKENIZER


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    draw, rows = random.Random(11), []
    passage = "\n".join(prose(900 + k, 12) for k in range(5))
    for k in range(160):
        lines = [prose(1000 * k + j, draw.randrange(8, 30)) + "." for j in range(draw.randrange(3, 9))]
        if k % 9 == 0:
            lines[1:1] = passage.split("\n")
        text = "\n".join(lines)
        rows.append((k, text, ("hot", "hot", "b", None)[k % 4]))
    rows += [(200 + k, rows[k][1], "copies") for k in range(20)]
    rows += [(230 + k, rows[30][1] + f" tail{k}", "copies") for k in range(10)]
    rows += [(300 + k, " ".join(w.upper() + "!!" for w in prose(k, 60).split()), "b") for k in range(40)]
    rows += [(400, None, "b"), (401, "", "b"), (None, prose(77, 80) + ".", "b")]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = make_docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = docs.where("doc_id is not null and doc_id % 3 > 0").select("doc_id", (~F.col("doc_id").between(300, 399)).cast("int").alias("quality"),
                                                                        F.lit(0).alias("toxic"))
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_and_columns(spark, corpus):
    folder, rows = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line-dedup", "near-dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_like_brute_force(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(quality.features([t for _, t, _ in rows]))
    kept = [r for r, s in zip(rows, scores) if s >= quality.CUT]
    assert not [i for i, _, _ in kept if i and 300 <= i < 400] and {i for i, _, _ in kept if i and i < 250} == {i for i, _, _ in rows if i and i < 250}

    source = {(i is None, i or 0): s for i, _, s in kept}
    kept = [(None if none else i, text, source[none, i]) for none, i, text, _ in brute_lines(kept)]
    assert sum("w" not in (t or "") for _, t, _ in kept) >= 15          # whole copies are empty now
    root = groups(len(kept), near_pairs([fingerprint(t) for _, t, _ in kept]))
    first = {}
    for (i, t, s), g in zip(kept, root):
        if i is not None or g not in first:
            old = first.get(g)
            if old is None or old[0] is None or i < old[0]:
                first[g] = (i, t, s)
    kept = list(first.values())

    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = Tokenizer.from_file(WORD_TOKENIZER)
    times = Counter(r.doc_id for r in pieces if r.start == 0)
    got = {}
    for r in pieces:
        got.setdefault(r.doc_id, {})[r.start] = np.frombuffer(r.ids, "<u4").tolist()
    sizes, taken = Counter(), Counter()
    for i, text, s in kept:
        n = len((text or "").split())
        sizes[s] += n
        taken[s] += n * times[i]
        assert times[i] <= 2
        if times[i]:
            ids = [x for _, part in sorted(got[i].items()) for x in part]
            assert ids == whole.encode(text, add_special_tokens=False).ids + [2]
    assert set(times) <= {i for i, _, _ in kept}
    for s, target in brute_targets(sizes).items():
        assert abs(taken[s] - target) <= 200, (s, taken[s], target)
