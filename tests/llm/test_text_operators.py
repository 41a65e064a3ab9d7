import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures_llm import documents, frame
from mezze.llm import bpe, licenses, linedup, mixing, mpeg, near, quality, tokens
from mezze.llm.common import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def by_text(rows, *names):
    out = defaultdict(set)
    for r in rows:
        out[r["doc_id"]].add(tuple(r[n] for n in names))
    return out


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def groups(rows, n, threshold):
    """Least doc_id reachable, by comparing all pairs."""
    sets = [(r[0], shingles(r[1], n)) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize(("n", "threshold"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(docs, n, threshold):
    want = groups(documents(), n, threshold)
    rows = near.near_duplicates(docs, words=n, threshold=threshold).collect()
    assert len(rows) == sum(r[0] is not None for r in documents())
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len(set(want.values())) <= len(want) - 5  # the fixture has groups


def test_template_texts_in_blocks(spark, monkeypatch):
    # Texts of one template, some just over the threshold, with edits that they share: no bound rules a pair out.
    monkeypatch.setattr(near, "BLOCK_ROWS", 16)
    monkeypatch.setattr(near, "COLUMNS", 64)
    rnd, rows = random.Random(3), []
    for i in range(90):
        said = [f"w{k}" for k in range(120)]
        for at in rnd.sample(range(120), 1 + i % 3):
            said[at] = rnd.choice(["xx", "yy"])
        rows.append((i, " ".join(said)))
    want = groups(rows, 5, 80)
    assert 10 < len(set(want.values())) < 80
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_shared_counts_and_labels():
    rnd = np.random.default_rng(1)
    sets = [[np.unique(rnd.integers(0, 40, n)) for n in (0, 5, 30, 60)] for _ in range(2)]
    assert near.shared_counts(*sets).tolist() == [[len(np.intersect1d(x, y)) for y in sets[1]] for x in sets[0]]
    links = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0]], bool)
    assert near._joined(links, np.array([7, 9, 4]), np.array([3, 8, 9])) == {(7, 3), (9, 3), (8, 3)}


def test_near_duplicates_of_nothing(empty):
    assert near.near_duplicates(empty).collect() == []


def test_keep_one_keeps_columns_and_rows_without_an_id(docs):
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    want = groups(documents(), 5, 80)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.filter("doc_id IS NULL").count() == 1


def test_quality_base_and_verdict(docs, empty):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(documents())
    got = by_text(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in documents():
        text = r[1] or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert want in got[r[0]]
    assert not any(r["kept"] for r in rows if r["base_failed"])
    assert quality.keep(docs).columns == docs.columns
    assert quality.keep(docs).count() == sum(r["kept"] for r in rows)
    assert quality.judge(empty).count() == 0


def test_quality_judges_words(spark):
    # Right language, wrong language, invented words; a language without a reference is judged by the nearest one.
    text = {
        "en": "The house of the old farmer stands near a quiet river and most people walk to it in the morning; children play beside small gardens, while dogs sleep under trees that nobody planted. ",
        "fr": "Le matin, les gens du village passent devant la maison de pierre et saluent une vieille fermière qui prépare le pain pour des voisins. Son jardin est petit, mais les enfants y jouent souvent, car la rivière coule au fond et un grand arbre donne de l’ombre dans cette chaleur que chacun redoute en juillet. ",
        "de": "Das Haus der alten Bäuerin steht in der Nähe von einem Fluss und die Leute gehen morgens zu ihr; Kinder spielen mit Hunden auf den kleinen Wiesen, während die Müller für sich schlafen. ",
        "es": "La casa de la vieja señora está cerca del río y los vecinos caminan en la mañana; unos niños juegan en el jardín, mientras que sus perros duermen por las calles de un barrio pequeño. ",
    }
    invented = " ".join(f"{a}{b}" for a in ("kel", "min", "ste", "dar", "vos", "tán", "pul", "ber") for b in ("or", "av", "upo", "ilt", "em", "ig.", "Esk", "ét"))
    # Windows of three words repeat in these texts, which is not what is tested here.
    rows = [(10 * i + j, text[said] * 4, lang) for i, said in enumerate(text) for j, lang in enumerate([*text, None, "xx"])]
    rows += [(100 + j, invented, lang) for j, lang in enumerate([*text, None, "xx"])]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_repeat_percent=100)
    kept = {r["doc_id"] for r in judged.collect() if r["kept"]}
    assert kept == {10 * i + j for i in range(4) for j in (i, 4, 5)}


def test_js_distance_is_a_distance(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))
    r = spark.range(1).select(quality.js_distance(a, a).alias("same"), quality.js_distance(a, b).alias("apart")).first()
    assert r["same"] == 0 and r["apart"] == 1


@pytest.mark.parametrize("lg_k", [4, 10])
def test_lines_on_many_sites_go_but_for_the_first(docs, empty, lg_k):
    # With a rough sketch, all lines are near the threshold and counted exactly.
    sites, first = defaultdict(set), {}
    lines = lambda t: [(x, x.strip(" \t\n\v\f\r")) for x in (t or "").split("\n")]
    for r in documents():
        for _, k in lines(r[1]):
            sites[k].add(r[3])
            if r[0] is not None:
                first[k] = min(first.get(k, r[0]), r[0])
    out = linedup.remove_boilerplate(docs, lg_k=lg_k)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    got = by_text(out.collect(), "text", "n_lines", "n_removed")
    removed = 0
    for r in documents():
        keep = [x for x, k in lines(r[1]) if not (k and len(sites[k]) >= linedup.MIN_SITES and first.get(k) != r[0])]
        n_removed = len(lines(r[1])) - len(keep)
        removed += n_removed
        assert (None if r[1] is None else "\n".join(keep), sum(bool(k) for _, k in lines(r[1])) if r[1] is not None else 0, n_removed) in got[r[0]]
    assert removed == 26
    assert out.count() == len(documents())
    assert linedup.remove_boilerplate(empty).count() == 0


def test_lines_of_rows_without_ids_stay_once(spark):
    shared = "A line that all sites share"
    rows = [(None, f"{shared}\nown {i}\n{shared}", f"s{i}") for i in range(12)]
    texts = [r["text"] for r in linedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()]
    assert sorted(t.count(shared) for t in texts) == [0] * 11 + [2] and all("own" in t for t in texts)
    named = linedup.remove_boilerplate(spark.createDataFrame([*rows, (7, shared, "s1")], "doc_id long, text string, source string")).collect()
    assert [r["doc_id"] for r in named if shared in r["text"]] == [7]


def test_classes_count_characters(spark):
    texts = {1: "かな" * 200, 2: "é" * 100 + "a" * 300, 3: "😀" * 250}
    rows = quality.measure(spark.createDataFrame([(k, v, "en") for k, v in texts.items()], "doc_id long, text string, lang string")).collect()
    assert {r["doc_id"]: (r["beyond"], r["n_text"]) for r in rows} == {1: (400, 400), 2: (100, 400), 3: (250, 250)}


def test_ties_of_a_draw_are_settled_by_text(spark):
    rows = [(1, f"word{i} x", "s") for i in range(40)] + [(2, "y " * 30, "t")]
    frames = [spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(n) for step, n in ((1, 1), (-1, 7))]
    one, two = ({(r["of"], r["copies"]) for r in mixing.mix(f).collect()} for f in frames)
    assert one == two


def test_large_ids_stay_next_to_nulls(spark):
    rows = spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in mpeg.index_media(mpeg.store_texts(rows)).collect()} == {2**60 + 1, None}
    assert {r["doc_id"] for r in tokens.count_tokens(rows, vocabulary("byte_bpe_50k.json")).collect()} == {2**60 + 1, None}


def test_bpe_equals_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.encode(docs, path).collect()
    assert len(rows) == len(documents())
    got = {(r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in rows}
    for r in documents():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert (r[0], tuple(ids), library.decode(ids, skip_special_tokens=False)) in got
    assert bpe.encode(empty, path).count() == 0


def test_pre_tokens_equal_the_librarys_for_every_character():
    from tokenizers import Tokenizer

    path, other = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    counts, bytes_ = tokens.Counts(other), Tokenizer.from_file(other)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    letters = lambda found: [w.encode().decode("latin-1").translate(own.letters) for w in found]
    for at in range(0, len(points), 5_000):
        text = "".join(f"a{chr(x)}1" for x in points[at : at + 5_000])
        assert letters(own.split(text)) == [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
        assert letters(counts.split(text)[0]) == [p for p, _ in bytes_.pre_tokenizer.pre_tokenize_str(text)]


def test_added_tokens_of_any_spelling(tmp_path):
    import json

    from tokenizers import Tokenizer

    for name, load in (("word_bpe_49k.json", bpe.Bpe), ("byte_bpe_50k.json", tokens.Counts)):
        with open(vocabulary(name), encoding="utf-8") as file:
            spec = json.load(file)
        for token, content in zip(spec["added_tokens"], ("[END]", "<s>")):
            if name.startswith("byte"):
                spec["model"]["vocab"][content] = spec["model"]["vocab"].pop(token["content"], token["id"])
            token["content"] = content
        path = f"{tmp_path}/{name}"
        with open(path, "w", encoding="utf-8") as file:
            json.dump(spec, file)
        text, library = "It's[END] over[END][END]<s> x [end]", Tokenizer.from_file(path)
        ids = library.encode(text, add_special_tokens=False).ids
        if load is bpe.Bpe:
            own = load(path)
            words = own.split(text)
            known = own.learn(set(words))
            raw = b"".join(known[w][0] for w in words)
            assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == ids
        else:
            split, n = load(path).split(text)
            assert n == text.count("[END]") and len(library.encode_batch(split, add_special_tokens=False)) == len(split)
            counts = load(path)
            assert sum(counts.learn(set(split))[t] for t in split) + n == len(ids)
        spec["added_tokens"][0]["lstrip"] = True
        with open(path, "w", encoding="utf-8") as file:
            json.dump(spec, file)
        with pytest.raises(ValueError, match="added token"):
            load(path)


def test_token_counts_shuffle_nothing(docs):
    plan = tokens.count_tokens(docs, vocabulary("byte_bpe_50k.json"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "MapInPandas" in plan


def test_trie_shares_states_and_survives_a_full_cache(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    own, library = bpe.Bpe(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "CACHE", 3)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    text = "international internationally internal intern in inn aaaaaaaa aaaaaaaaa zzyzx'll ☃️☃ 日本 ééé"
    for part in (text, text[::-1], text):
        words = own.split(part)
        known = own.learn(set(words))
        ids = b"".join(known[w][0] for w in words)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == library.encode(part, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = by_text(tokens.count_tokens(docs, path).collect(), "n_bytes", "n_tokens", "over_limit")
    for r in documents():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        assert (len((r[1] or "").encode()), n, n > 512) in got[r[0]]
    assert tokens.count_tokens(empty, path).count() == 0


def test_fit_finds_the_best_subset():
    import itertools

    for sizes, counts, budget in [([3, 7, 11], [2, 2, 1], 20), ([5, 9], [3, 3], 17), ([4], [5], 9), ([2, 3], [1, 1], 4), ([0, 6], [9, 2], 7), ([10], [2], 0)]:
        best = min(abs(budget - sum(s * k for s, k in zip(sizes, ks))) for ks in itertools.product(*(range(n + 1) for n in counts)))
        take = mixing.fit(sizes, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        assert abs(budget - sum(s * t for s, t in zip(sizes, take))) == best


def test_mix_meets_its_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(documents())
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    assert sum(target.values()) == pytest.approx(min(sum(size.values()), 3 * sum(size.values())))
    # Plain water-filling.
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight, want, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(size.values())
    open_ = set(order)
    while open_:
        level = (total - sum(want.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        want |= {s: 3 * size[s] for s in full} if full else {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    assert target == pytest.approx(want)
    again = {(r["doc_id"], r["of"], r["copies"]) for r in mixing.mix(docs.orderBy(F.rand())).collect()}
    assert again == {(r["doc_id"], r["of"], r["copies"]) for r in rows}
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert sum(len(WORD.findall(r["text"] or "")) for r in drawn.collect()) == sum(taken.values())
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0


def test_audio_keeps_texts(docs, empty):
    rows = mpeg.index_media(mpeg.store_texts(docs)).collect()
    assert len(rows) == len(documents())
    for r in documents():
        raw = (r[1] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert any(x["n_bytes"] == len(raw) and bytes(x["payload"]) == padded and x["n_bad"] == x["n_skipped"] == 0 for x in rows if x["doc_id"] == r[0])
    assert all(r["n_frames"] == r["declared_frames"] == r["n_checked"] and r["n_samples"] == 1152 * r["n_frames"] for r in rows)
    assert mpeg.index_media(mpeg.store_texts(empty)).count() == 0


def test_audio_resynchronises_and_checks():
    payload = bytes(range(256)) * 20
    audio = mpeg.write(payload, {"n_bytes": "5120"})
    clean = mpeg.index(audio)
    assert clean["payload"][:5120] == payload and clean["bad"] == clean["skipped"] == 0 and clean["tags"] == {"n_bytes": "5120"}
    at = clean["offsets"][1]
    junk = mpeg.index(audio[:at] + b"\xff\xfbjunk\xff" + audio[at:])
    assert junk["payload"][:5120] == payload and junk["skipped"] == 7 and len(junk["offsets"]) == len(clean["offsets"])
    flipped = bytearray(audio)
    flipped[at + 8] ^= 1
    assert mpeg.index(bytes(flipped))["bad"] == 1
    assert mpeg.index(b"no audio at all \xff\xff")["offsets"] == []
    assert mpeg.index(b"")["samples"] == 0
    assert mpeg.header(bytes((0xFF, 0xFB, 0x90, 0))) == (417, 1152, 44100, 3, False, 32)


def test_audio_knows_the_vbri_table():
    audio = mpeg.write(bytes(range(256)) * 20, {})
    clean = mpeg.index(audio)
    frame = bytearray(bytes((0xFF, 0xFB, 0xE8, 0xC0)) + bytes(1436))
    frame[36:54] = b"VBRI" + (1).to_bytes(2) + bytes(4) + (0).to_bytes(4) + (77).to_bytes(4)
    at = clean["offsets"][0]
    found = mpeg.index(bytes(frame) + audio[at:])
    assert found["declared"] == 77 and found["offsets"] == [x - at + 1440 for x in clean["offsets"]]
    assert found["samples"] == clean["samples"] and found["payload"] == clean["payload"] and found["skipped"] == 0


def test_licenses_of_any_width_under_their_titles(spark):
    import textwrap

    titles = {"MIT": "MIT License", "ISC": "ISC License (ISCL)", "0BSD": "Zero-Clause BSD License", "BSD-2-Clause": "The 2-Clause BSD License", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License'}
    rows, want = [], {}
    for name, text in licenses.KNOWN[:5]:
        for width in range(40, 111):
            wrapped = "\n\n".join("\n".join(textwrap.wrap(part, width)) for part in text.split("\n\n"))
            want[len(rows)] = name
            rows.append((len(rows), f"{titles[name]}\n\nCopyright {width + 1900} A Person <a@b.org>\n\n{wrapped}\n" if width % 2 else f" Copyright (c) <year> <owner>. All rights reserved.\n{wrapped}"))
    rows += [(1000, "MIT License\n"), (1001, "Released under the MIT License.\n"), (1002, "MIT License\n\nbut another text")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {1000: None, 1001: "MIT", 1002: None}


def test_licenses_in_other_spelling(spark, docs, empty):
    mit = dict(reversed(licenses.KNOWN))["MIT"]
    isc = next(t for n, t in licenses.KNOWN if n == "ISC")
    rows = [
        (1, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", "")), (2, isc.replace('"', "“")), (3, "no license"), (4, None), (5, "text\n  released under the MIT Licence \nmore"), (5, mit + " and more"),
    ]
    got = {(r["doc_id"], r["license"], tuple(r["line_licenses"])) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", ()), (2, "ISC", ()), (3, None, ()), (4, None, ()), (5, None, ("MIT",)), (5, None, ())}
    assert licenses.scan(docs).count() == len(documents()) and licenses.scan(empty).count() == 0
    nothing = licenses.scan(docs).filter("doc_id = 0").first()
    assert nothing["n_words"] == 0 and nothing["canonical_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("edges", [[], [(2, 1), (3, 1), (9, 4), (5, 5)], [(i, i + 1) for i in range(60)], [(i * 7 % 90, i * i % 97 + 200 * (i % 3)) for i in range(150)]])
def test_components_are_the_least_nodes(spark, edges):
    least = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in near.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in least.items() if n != c}
