"""The pipeline against its stages in plain Python, on the smallest tables."""

import base64
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from loomgraph.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    return read("documents"), read("labels"), read("benchmark")


def _rejected(text: str, rules) -> bool:
    n, chars, symbols, dup, repeat, _ = brute.statistics(text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    values = dict(zip(quality.FEATURES, (n, chars / n, symbols / n, text.count("!") / n, len(re.findall("[A-Z]", text)) / chars, dup / len(lines), repeat / n, len(set(words)) / n), strict=True))
    return any(all(values[quality.FEATURES[t.feature]] >= t.value if t.at_least else values[quality.FEATURES[t.feature]] <= t.value for t in rule) for rule in rules)


def _redacted(text: str) -> str:
    at, out = 0, []
    for s in brute.base_spans(text):
        a, b = map(int, s[2].split(":")[1:])
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_pipeline(spark, tables):
    documents, labels, benchmark = tables
    rules = quality.fit(documents, labels)
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    docs = {i: t for i, t in docs.items() if not brute.statistics(t)[5] and not _rejected(t, rules)}
    groups = brute.near_duplicates(list(docs.items()))
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    docs = {i: _redacted(t) for i, t in docs.items() if not brute.contaminated(t, items)[4]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        ids = library.encode_ordinary(t)
        want[i] = (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < documents.count()


def test_stages_keep_columns(spark, tables):
    documents = tables[0]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents.limit(0), SF).columns == documents.columns
