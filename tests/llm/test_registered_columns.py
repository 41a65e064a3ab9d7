"""The columns of registered queries that have no SQL, against plain Python over the whole test tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from fixtures_llm import frame
from mezze.llm import mixing, registry
from mezze.llm.common import table, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(said):
    return hashlib.sha256(said if isinstance(said, bytes) else said.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def answers(spark, sf_dir, name):
    rows = registry.queries()[name](spark, sf_dir).collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op2(spark, sf_dir, texts):
    got, by_text = answers(spark, sf_dir, "op2_mpeg_audio"), {}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
        media = (r["media_bytes"], r["media_sha256"], r["feature"])
        assert by_text.setdefault(text, media) == media and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["media_bytes"] > len(payload)


@pytest.mark.parametrize(("name", "file"), [("op4_bpe", "word_bpe_49k.json"), ("op6_token_counts", "byte_bpe_50k.json")])
def test_tokens(spark, sf_dir, texts, name, file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(file))
    library.no_truncation()
    library.no_padding()
    got = answers(spark, sf_dir, name)
    assert got.keys() == texts.keys()
    for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False)):
        assert got[i]["n_tokens"] == len(e.ids)
        if name == "op4_bpe":
            assert (got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False)))
        else:
            assert (got[i]["n_bytes"], got[i]["over_limit"]) == (len(texts[i].encode()), len(e.ids) > 512)


def poured(sizes):
    """Targets by repeated pouring: what is above three times a source's size goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while len(full) < len(order):
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in open_}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]
    return full


def nearest(sizes, goal):
    """Words of the choice of whole documents that come nearest, by a set of all sums."""
    bits = 1
    for s, n in Counter(sizes).items():
        part = 1
        while n > 0:
            part = min(part, n)
            bits |= bits << part * s
            n -= part
            part *= 2
    below, above = bits & ((1 << (goal + 1)) - 1), bits >> goal
    return min(goal - (below.bit_length() - 1), (above & -above).bit_length() - 1 if above else goal)


def mixed(rows, docs):
    sizes, by_source = Counter(), {}
    for source, text in docs:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        by_source.setdefault(source, []).append(n)
    targets, taken = poured(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source, all_ in by_source.items():
        goal = round(targets[source])
        epochs = goal // sizes[source] if sizes[source] else 0
        assert abs(taken[source] - goal) == nearest(all_, goal - epochs * sizes[source])


def test_op10(spark, sf_dir):
    rows = registry.queries()["op10_mix"](spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs)
    mixed(rows, [(r["source"], r["text"]) for r in docs])


def test_mix_of_many_small_sources(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randint(0, 40)), "en", None if i % 97 == 0 else f"s{int(rnd.paretovariate(0.7)) % 60}", 0) + (None,) * 13 for i in range(900)] + [(1, None, "en", "none", 0) + (None,) * 13]
    mixed(mixing.mix(frame(spark, rows)).collect(), [(r[3], r[1]) for r in rows])


def test_fit_comes_as_near_as_any_choice():
    rnd = random.Random(9)
    cases = [([49_265, 54_621], [25, 5], 476_259), ([1000, 2000, 7], [900, 900, 3], 1_234_567), ([60_000], [9], 100_000), ([0, 5], [3, 1], 4)]
    for _ in range(60):
        sizes = sorted(rnd.sample(range(50, 60_001), rnd.randint(2, 7)))
        counts = [rnd.randint(1, 25) for _ in sizes]
        cases.append((sizes, counts, rnd.randint(1, sum(s * n for s, n in zip(sizes, counts)))))
    for sizes, counts, budget in cases:
        got = mixing.fit(sizes, counts, budget)
        assert all(0 <= g <= n for g, n in zip(got, counts))
        whole = [s for s, n in zip(sizes, counts) for _ in range(n)]
        assert abs(sum(s * g for s, g in zip(sizes, got)) - budget) == nearest(whole, budget), (sizes, counts, budget)
