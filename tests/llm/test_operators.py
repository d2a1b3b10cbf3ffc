"""The training-data operators against brute force, public libraries and exact round trips.

ROWS has what every operator has to stand: null and empty texts, null and repeated ids, equal rows,
texts without words, long texts, and other columns whose names clash with the operators' own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tessella.llm import byte_bpe, fingerprint, langid, licenses, packing, pii, quality, simhash, toxicity, urls
from tessella.llm.queries import BYTE_RANKS, WORD_VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, n_words long, key string, bucket int"
_PROSE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from an old oak tree near the quiet river bank"
TEXTS = [
    _PROSE, _PROSE, _PROSE + " today", None, "", "   \n\t ", "Straße café naïve über 東京 Ünïcödé 😀😀 it's", "one", "ONE", "a b",
    " ".join(f"w{i * 7919 % 1009}" for i in range(3000)), "x" * 5000, "a\n\nb\na\nb\n" * 30, "mail bob@example.com or +1 (555) 010-2030, ip 10.0.0.1 card 4111 1111 1111 1111.",
    "x\u00a0y\u2028z \u1680 \x1c end", "1/2 ½ x² ١٢٣ 12345", "released under the MIT License; licensed under the Apache License, version 2.0",
]
ROWS = [(i, t, "en", f"s{i % 3}", len(t or ""), i, i, "k", 1) for i, t in enumerate(TEXTS)]
ROWS += [(None, _PROSE, None, None, None, None, None, None, None), (3, "other text of a repeated id", "de", "s0", 1, 1, 1, "k", 1), ROWS[0]]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def slow_fingerprint(text: str | None) -> int:
    words = _WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: list[int], least: int = 2) -> list[int]:
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= least:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash_fingerprints_and_classes(docs, none):
    got = simhash.near_duplicates(docs).collect()
    prints = [slow_fingerprint(r[1]) for r in ROWS]
    groups = components(prints)
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if groups[i] == g and ROWS[i][0] is not None), default=None) for g in groups}
    want = Counter((r[0], p, least[g]) for r, p, g in zip(ROWS, prints, groups, strict=True))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(groups))


def test_tally_of_postings_tells_six_shared_bytes(spark):
    """Pairs with 6 positional bytes or more in common share 3 postings or more, all others one at most."""
    rng = np.random.default_rng(7)
    pairs = []
    for changed in range(9):
        for _ in range(20):
            a = rng.integers(0, 256, 8)
            b = a.copy()
            for k in rng.choice(8, changed, replace=False):
                b[k] ^= rng.integers(1, 256)
            pairs.append((changed, *(int.from_bytes(bytes(x.astype(np.uint8)), "little", signed=True) for x in (a, b))))
    rows = spark.createDataFrame(pairs, "changed int, a long, b long")
    got = rows.select("changed", simhash.F.size(simhash.F.array_intersect(simhash._keys(simhash.F.col("a")), simhash._keys(simhash.F.col("b")))).alias("n")).collect()
    assert all(r.n == {0: 14, 1: 7, 2: 3}[r.changed] if r.changed <= 2 else r.n <= 1 for r in got)


def test_ties_in_id_keep_one_row(spark):
    rows = [(4, "a b c d e f g h"), (4, "a b c d e f g h"), (4, "A b c d e f g h"), (None, "a b c d e f g h"), (9, "zz yy xx ww vv uu tt")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [4, 9]


@pytest.mark.parametrize("cap", [2, 48])
def test_simhash_links_have_all_pairs_components(spark, cap):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    prints = list(dict.fromkeys(seeds + [s ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds[:12] for a, b in rng.integers(0, 63, (25, 2))]))
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), cap).collect()
    place = {p: i for i, p in enumerate(prints)}
    linked = {(place[r.src], place[r.dst]) for r in edges}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in linked)
    parent = list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(prints))] == components(prints)


@pytest.mark.parametrize(("chunk", "overlap"), [(byte_bpe.CHUNK, byte_bpe.OVERLAP), (64, 16), (7, 3)])
def test_byte_bpe_equals_the_library_and_round_trips(docs, none, chunk, overlap):
    path = public_tokenizers.path(BYTE_RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in byte_bpe.decode(encoded, path).collect())
    assert got == Counter((r[0], tuple(known.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS)
    assert byte_bpe.encode(none, path, public_tokenizers.PATTERN).count() == 0


def test_packing_pieces_and_places(docs, none):
    path = public_tokenizers.path(WORD_VOCABULARY)
    known, capacity = Tokenizer.from_file(path), 64
    got = packing.pack(docs, path, capacity).collect()
    want = Counter()
    for r in ROWS:
        ids = [*known.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[r[0], k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= capacity
    assert packing.pack(none, path).count() == 0


def test_word_ids_are_the_library_s_at_every_code_point():
    path = public_tokenizers.path(WORD_VOCABULARY)
    own, known = packing.WordBpe(path), Tokenizer.from_file(path)
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 37)] if not 0xD800 <= c < 0xE000]
    texts = [f"ab{c}Cd {c} 1{c}'s{c}" for c in points] + ["hello <|endoftext|> world", "<|startoftext|>a", "< | <|", "İstanbul ΑΣ e\u0301"]
    for k in range(0, len(texts), 5000):
        part = texts[k : k + 5000]
        want = [e.ids for e in known.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode(part)] == want


def test_places_of_a_frequent_length(spark):
    """Ranks are drawn partition by partition: no place is given twice, none is left out."""
    lengths = [40] * 900 + [20, 21, 60, 1] * 30
    sized = spark.createDataFrame(list(enumerate(lengths)), "id long, length int").repartition(7)
    got = packing.place(sized, 60).collect()
    assert sorted(r.id for r in got) == list(range(len(lengths)))
    taken = sorted((r.sequence_id, p) for r in got for p in range(r.offset, r.offset + r.length))
    assert len(set(taken)) == len(taken) and max(p for _, p in taken) < 60


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_at_most_one_sequence_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 200).tolist()
    _, bins, _ = packing.plan(dict(Counter(lengths)), 60)
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(60 - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    assert -(-sum(lengths) // 60) <= bins <= len(rooms) + 1


def test_quality_figures_and_verdicts(docs, none):
    def figures(text):
        words, lines = _WORD.findall(text or ""), [x for x in (text or "").split("\n") if _WORD.search(x)]
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(wins)
        covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(3)}
        n = len(words)
        return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n

    rows = quality.judge(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((r[0], *figures(r[1])) for r in ROWS)
    assert all(not (r.kept and r.base_failed) for r in rows) and quality.judge(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_bad_hosts_go_and_good_hosts_stay(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, "short" if i % 2 else good, "en", "bad" if i < 200 and (i % 2 or i % 20 == 0) else "good", 0) for i in range(0, 400)]
    got = {(r.host_rate > quality.HOST_LIMIT, r.kept) for r in quality.judge(spark.createDataFrame([r for r in rows if r[3] == "bad"] + [r for r in rows if r[3] == "good" and not r[0] % 2], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == {(True, False), (False, True)}


def test_url_rules_and_propagation(spark):
    link = '<a href="http://{}/x">'
    rows = [
        (1, "http://A.com/x?q", link.format("friend.org")), (2, "https://sub.example.com/en/1", ""), (3, "http://www.example.com/en/", None), (4, "http://bad.net/es/y", link.format("other.net")),
        (5, "http://friend.org/", ""), (6, "http://spam.org/p", link.format("bad.net")), (7, None, None), (8, "nothing", ""), (9, "x://notexample.com/en/", ""), (1, "http://A.com/x?q", ""),
    ]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter([
        (1, "a.com", "/x", "com/", "allow"), (1, "a.com", "/x", "com/", "allow"), (2, "sub.example.com", "/en/1", "example.com/en/", "block"), (3, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (4, "bad.net", "/es/y", "net/es/", "block"), (5, "friend.org", "/", None, "allow"), (6, "spam.org", "/p", None, "block"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "notexample.com", "/en/", "com/", "allow"),
    ])
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def slow_rank(seed: dict[str, float], edges: list[tuple[str, str, float]], rounds: int = urls.ROUNDS, damping: float = urls.DAMPING) -> dict[str, float]:
    """Personalised PageRank with a dense matrix."""
    hosts = sorted(seed)
    at, n = {h: i for i, h in enumerate(hosts)}, len(seed)
    s = np.array([seed[h] for h in hosts])
    move = np.zeros((n, n))
    for a, b, w in edges:
        move[at[b], at[a]] += w
    out = move.sum(axis=0)
    move[:, out == 0] = (s / s.sum())[:, None]  # dead ends start anew
    move[:, out > 0] /= out[out > 0]
    r = s.copy()
    for _ in range(rounds):
        r = (1 - damping) * s + damping * move @ r
    return dict(zip(hosts, r, strict=True))


def web(seed: int = 5) -> tuple[dict[str, float], list[tuple[str, str, float]]]:
    """Hosts with a hub that links to half of all, one that half of all link to, dead ends and lone hosts."""
    rng = np.random.default_rng(seed)
    hosts = [f"h{i}" for i in range(60)]
    edges = {("h0", h) for h in hosts[1:30]} | {(h, "h1") for h in hosts[20:50]} | {(hosts[a], hosts[b]) for a, b in rng.integers(0, 40, (80, 2)) if a != b}
    return {h: float(rng.integers(0, 3)) / 2 for h in hosts}, [(a, b, float(rng.integers(1, 5))) for a, b in sorted(edges) if a != b]


def test_propagation_equals_a_dense_pagerank(spark):
    seed, edges = web()
    rows = urls.propagate(spark.createDataFrame(list(seed.items()), "host string, seed double"), spark.createDataFrame(edges, "src string, dst string, weight double")).collect()
    got = {r.host: r.score for r in rows}
    assert all(abs(r.score / r.unit - seed[r.host]) < 1e-9 for r in rows if r.host not in {b for _, b, _ in edges})
    want = slow_rank(seed, edges)
    assert set(got) == set(want) and all(abs(got[h] - want[h]) < 1e-9 for h in want)
    assert abs(sum(got.values()) - sum(seed.values())) < 1e-9
    alone = urls.propagate(spark.createDataFrame(list(seed.items()), "host string, seed double"), spark.createDataFrame([], "src string, dst string, weight double")).collect()
    assert {r.host: r.score for r in alone} == seed


def test_verdicts_equal_the_sql_on_a_linked_web(spark, duck):
    rng = np.random.default_rng(9)
    hosts = [f"a{i}.com" for i in range(8)] + [f"b{i}.net" for i in range(8)] + [f"c{i}.org" for i in range(12)]
    rows = []
    for i in range(400):
        links = "".join(f'<a href="http{"s" * int(rng.integers(0, 2))}://{hosts[int(rng.integers(0, 28))]}/x"> <img src=//{hosts[int(rng.integers(0, 28))].upper()}/y>' for _ in range(int(rng.integers(0, 4))))
        rows.append((i, f"http://{hosts[int(rng.integers(0, 28))]}/{['es', 'fr', 'de', 'en'][i % 4]}/{'p' * int(rng.integers(0, 9))}", links, "x", 1.0, "y"))
    rows += [(500 + i, f"http://lone.net/{'de' if i == 9 else 'es'}/", "", "x", 1.0, "y") for i in range(10)]
    rows += [(401, None, None, None, None, None), (401, "no host", "<a href=//a1.com>", "x", 1.0, "y"), (402, "http://hub.org/" + "q" * 200_000, "<a href=http://b0.net/>" * 20_000, "x", 1.0, "y"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, score double, src string")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect())
    duck.register("pages_frame", pages.select("page_id", "url", "html").toPandas())
    sql = urls.oracle_sql().replace(" from pages)", " from pages_frame)")
    assert got == Counter(duck.execute(f"select page_id, host, path, rule, verdict from ({sql})").fetchall())
    assert {(r.rule, r.verdict) for r in urls.judge(pages).where("rule is null").collect()} == {(None, "allow"), (None, "block")}


def test_license_phrases_and_templates(docs, none):
    def base(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        hits = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES.items() if tuple(words[i : i + len(phrase)]) == phrase]
        at = [i for i, _ in hits]
        return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    rows = licenses.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows) == Counter((r[0], *base(r[1])) for r in ROWS)
    assert {r.labels for r in rows} == {"", "apache,apache-2.0,mit"} and licenses.scan(none).count() == 0


def rendered(template: str, optional: bool) -> str:
    """A text of a template: optional regions in or out, replaceable ones filled or empty."""
    out, depth = [], 0
    for token in template.split():
        if token == "<<optional>>":
            depth += 1
        elif token == "<<end>>":
            depth -= 1
        elif token.startswith("<<var:"):
            out += ["Acme", "Corp"] if optional and not depth or optional else []
        elif not depth or optional:
            out.append(token)
    return " ".join(out)


def test_every_template_is_found_in_prose_and_no_half_of_it():
    matcher = licenses.Matcher(licenses.TEMPLATES)
    found = total = 0
    for label, each in licenses.TEMPLATES.items():
        for template in each:
            automaton = licenses.Automaton(template)
            for optional in (False, True):
                words = rendered(template, optional).split()
                text = "Some words before. " + ", ".join(w.upper() for w in words) + "; some words after it"
                total += 1
                found += label in licenses.scan_text(text, matcher)[5].split(",")
            last = max(i for i, w in enumerate(words) if w.encode() in automaton.mandatory)
            broken = [w.encode() for i, w in enumerate(words) if i != last]
            assert not any(automaton.run(broken, i)[0] for i in range(len(broken))), template
    assert found == total


@pytest.mark.parametrize(("text", "labels"), [
    ("GNU Lesser General Public License as published by the Free Software Foundation; version 2.1", "gpl"),
    ("under the GNU Lesser General Public License version 2.1", "gpl,lgpl"), ("licensed under the GNU General Public License, version 2.1", "gpl"), ("licensed under the GNU General Public License, version 2.0.", "gpl,gpl-2.0"),
    ("Distributed under the MIT license.", "mit"), ("BSD 3-Clause License", "bsd,bsd-3-clause"), ("SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
    ("license", ""), ("nothing here", ""),
    ("SPDX-License-Identifier: MIT-0", ""), ("SPDX-License-Identifier: BSD-2-Clause-Patent", ""), ("spdx-license-identifier: BSD-3-Clause-Clear", ""), ("SPDX-License-Identifier: BSD-3-Clause-No-Nuclear-License", ""),
    ("// SPDX-License-Identifier: (MIT OR Apache-2.0)\nISC goes on", "apache-2.0,mit"), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause", "bsd-3-clause,gpl-2.0"),
    ("# SPDX-License-Identifier: GPL-3.0+ and zlib", "gpl-3.0,zlib"), ("SPDX-License-Identifier: MIT\nisc", "mit"), ("SPDX-License-Identifier: MIT. And more", "mit"), ("SPDX-License-Identifier: OR MIT", ""), ("SPDX-License-Identifier:", ""),
    ("SPDX-License-Identifier: mit-or-later", ""), ("SPDX-License-Identifier: CC-BY-SA-4.0 OR Unknown-1.0", "cc-by-sa-4.0"), ("licensed under the GNU GPL v3", "gpl-3.0"), ("GNU Affero General Public License v3.0", "agpl-3.0,gpl"),
    ("GNU General Public License v2.1", "gpl"), ("the GNU General Public License, version 2, or any later", "gpl,gpl-2.0"), ("under the Apache License v2.0", "apache,apache-2.0"), ("Mozilla Public License, v. 2.0", "mpl-2.0"),
])
def test_labels_of_notices(text, labels):
    assert licenses.scan_text(text, licenses.Matcher(licenses.TEMPLATES))[5] == labels


def test_own_templates_need_no_known_word(spark):
    rows = spark.createDataFrame([(1, "Use it for good, friend, forever"), (2, "use it")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(rows, {"good": ["use it for <<var:1>> <<optional>> friend <<end>> forever"]}).collect()}
    assert got == {1: "good", 2: ""}
    with pytest.raises(ValueError, match="mandatory"):
        licenses.Automaton("<<optional>> a <<end>> <<var:3>>")


def test_optional_and_replaceable_regions():
    a = licenses.Automaton("begin <<optional>> maybe this <<end>> <<var:2>> finish")
    for words, ok in (("begin finish", True), ("begin maybe this finish", True), ("begin any two finish", True), ("begin maybe this any two finish", True), ("begin one two three finish", False), ("begin maybe", False)):
        assert a.run([w.encode() for w in words.split()], 0)[0] is ok, words


def test_base_spans_equal_the_patterns(docs, none):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("a1.@-+ 2()5"), 60)) for _ in range(400)] + [t or "" for t in TEXTS]
    for text in texts:
        got = pii.base_spans(text)
        assert got["email"] == [m.span() for m in email.finditer(text)]
        assert got["ip"] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        digits = lambda m: [int(c) for c in m[0] if c in "0123456789"]
        valid = lambda d: sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        assert got["card"] == [m.span() for m in card.finditer(text) if 16 <= len(digits(m)) <= 19 and valid(digits(m))]
        assert got["phone"] == [m.span() for m in phone.finditer(text) if 8 <= len(digits(m)) <= 15]
    assert sum(len(pii.base_spans(t)["card"]) for t in ["".join(rng.choice(list("0123456789 -"), 40)) for _ in range(400)]) > 10
    rows = pii.personal_data(docs).collect()
    assert Counter((r.doc_id, tuple(r.base)) for r in rows) == Counter((r[0], tuple(s for k in pii.KINDS for s in pii.joined(k, pii.base_spans(r[1] or "")[k]))) for r in ROWS)
    row = next(r for r in rows if r.doc_id == 13)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and row.spans[:4] == row.base
    assert pii.personal_data(none).count() == 0
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    assert masked.where("doc_id = 13").first().text == "mail [email] or [phone], ip [ip] card [card]."


def test_patterns_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"please write to user{i}@example.org for more") for i in range(30)] + [(99, "please write to user4711-x for more"), (100, "order number part4711-x was sent")]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == ["context:16:26"] and got[100] == [] and len(got) == len(rows)


def slow_contexts(text: str, spans: list[tuple[int, int]]) -> list[set[str]]:
    """The patterns by a walk over the text for each span."""
    out = []
    for start, stop in spans:
        left = max([b for _, b in spans if b <= start], default=0)
        at = start
        while at > 0 and _WORD.match(text[at - 1]):
            at -= 1
        words = _WORD.findall(text[:at])
        if left > at:
            before = ["<id>" + lower(text[left:start])]
        else:
            before = [lower(w) for w in words[-2:]]
            glue = lower(text[at:start])
            before = [*before[:-1], f"{before[-1]} {glue}"] if glue and before else [glue] if glue else before
        end = stop
        nearest = min([a for a, _ in spans if a >= stop], default=len(text))
        while end < len(text) and end < nearest and _WORD.match(text[end]):
            end += 1
        after = lower(text[stop:end])
        if not after and stop < nearest:
            rest = re.compile(r"[\x20\x09-\x0D]+").sub("", text[stop:nearest])
            after = lower(_WORD.search(text, stop)[0]) if rest and not _WORD.match(text[stop]) else ""
            if _WORD.search(text, stop):
                m = _WORD.search(text, stop)
                after = lower(text[m.start() : max(m.start(), min(m.end(), nearest))]) or "<id>"
        own = {"L " + " ".join(before)} if len(before) == 2 or (before and before[0].startswith("<id>")) else set()
        out.append(own | ({f"B {before[-1]} _ {after}"} if before and after else set()))
    return out


def slow_pii(texts: list[str]) -> list[set[tuple[int, int]]]:
    """Contextual spans by plain loops over dictionaries."""
    met = []
    for t in texts:
        base = pii.base_spans(t)
        every = pii.mentions(t, base)
        met.append([(m, c) for m, c in zip(every, slow_contexts(t, [m[3:] for m in every]), strict=True)])
    edges = {(p, m[0], m[1]) for each in met for m, c in each for p in c}
    scores = {e: float(e[2]) for e in edges}
    for k in range(pii.ROUNDS):
        of = defaultdict(list)
        for e, s in scores.items():
            of[e[0]].append((s, e[2]))
        confidence = {p: sum(s for s, _ in each) / (len(each) + pii.SHRINK) for p, each in of.items()}
        miss = defaultdict(lambda: 1.0)
        for p, x, seed in edges:
            if not seed:
                miss[x] *= max(1 - confidence[p], 1e-9)
        scores = {e: 1.0 if e[2] else 1 - miss[e[1]] for e in edges}
    good = {p for p, c in confidence.items() if c >= pii.MIN_CONFIDENCE and sum(s for _, s in of[p]) >= pii.MIN_SEEDS}
    return [{m[3:] for m, c in each if not m[2] and c & good} for each in met]


def planted_identifiers(n: int = 240) -> list[tuple[str, int, int]]:
    """(text, start, end) of one unseen identifier each, behind words that also precede seeds; the end is 0 where a seed stands there."""
    rng = np.random.default_rng(6)
    lead = ["please write to", "call us under the number", "server at address", 'api secret = "']
    seeds = [lambda: f"user{rng.integers(1e6)}@mail.example.org", lambda: f"+49 30 {rng.integers(1e6, 9e6)}", lambda: f"10.{rng.integers(255)}.{rng.integers(255)}.7", lambda: "".join(rng.choice(list("abcdef0123456789"), 36)) + "a1" * 2]
    out = []
    for i in range(n):
        k = i % 4
        words = [f"w{x}" for x in rng.integers(0, 5000, 30)]
        at = int(rng.integers(0, 30))
        own = f"id{rng.integers(1000, 9999)}x{rng.integers(1000, 9999)}" if i % 3 == 0 else seeds[k]()
        before = " ".join(words[:at]) + f" {lead[k]}" + ("" if k == 3 else " ")
        out.append((before + own + ('" ' if k == 3 else " ") + " ".join(words[at:]), len(before), len(before) + len(own) if i % 3 == 0 else 0))
    return out


def test_pattern_graph_and_recall_of_planted_identifiers(spark):
    planted = planted_identifiers()
    texts = [t for t, _, _ in planted] + ["a mail@x.example.org,12345678 99887766;+49 30 1234567/4444x5555 end", "x" * 300 + "11112222" + "y" * 300, "12345678" * 40]
    got = {r.doc_id: {(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans) if k == "context"} for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == slow_pii(texts)
    wanted = [(i, (a, b)) for i, (_, a, b) in enumerate(planted) if b]
    assert sum(span in got[i] for i, span in wanted) >= 0.9 * len(wanted)
    stray = sum(len(got[i] - {(a, b)}) for i, (_, a, b) in enumerate(planted) if b)
    assert stray <= 0.1 * len(wanted)


def test_candidates_are_whole_tokens_and_contexts_whole_words():
    token = "a1b2c3d4e5" * 10
    assert pii.mentions(f"see {token} there", pii.base_spans(""))[0][3:] == (4, 104)
    far = "v" * 200
    assert pii.contexts(f"{far} {far} 12345678 {far} z", [(402, 410)]) == [[f"L {far} {far}", f"B {far} _ {far}"]]


def test_overlapping_spans_are_masked_whole():
    text = "x +1 555 010 2030 44@mail.org y"
    spans = [(a, b, k) for k, each in pii.base_spans(text).items() for a, b in each]
    assert {k for _, _, k in spans} == {"phone", "email"} and pii.masked(text, spans) == "x [phone] y"
    assert pii.masked("abcdef", [(1, 3, "a"), (2, 5, "b"), (0, 1, "c")]) == "[c][a]f"


def test_null_and_repeated_ids_keep_their_rows(spark):
    rows = [(None, "mail a1@b.org"), (None, "mail a1@b.org"), (None, None), (1, "mail a1@b.org"), (1, "ip 1.2.3.4"), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, tuple(r.spans)) for r in pii.personal_data(docs).collect()) == Counter([(None, ("email:5:13",))] * 2 + [(None, ()), (1, ("email:5:13",)), (1, ("ip:3:10",)), (1, ())])
    assert Counter((r.doc_id, r.text) for r in pii.mask(docs).collect()) == Counter([(None, "mail [email]")] * 2 + [(None, None), (1, "mail [email]"), (1, "ip [ip]"), (1, "")])


@pytest.fixture(scope="module")
def toxic_model():
    rng = np.random.default_rng(2)
    texts = [" ".join([*rng.choice([f"plain{i}" for i in range(60)], 30), f"vile{rng.integers(0, 4)}" if k % 3 == 0 else "plain0"]) for k in range(120)]
    return toxicity.train(texts, [int(k % 3 == 0) for k in range(120)], steps=40)


def test_toxicity_learns_words_and_scores_whole_texts(spark, docs, none):
    rng = np.random.default_rng(0)
    words = [f"plain{i}" for i in range(60)]
    texts, labels = [], []
    for k in range(500):
        own = rng.choice(words, int(rng.integers(20, 120))).tolist()
        if k % 3 == 0:
            own[int(rng.integers(0, len(own)))] = f"vile{rng.integers(0, 4)}"
        texts.append(" ".join(own))
        labels.append(int(k % 3 == 0))
    model = toxicity.train(texts[:400], labels[:400], steps=250)
    scores = toxicity.Scorer(model).scores(texts[400:])
    assert np.mean((scores >= 0.5) == np.array(labels[400:])) > 0.9
    late = " ".join(["plain1"] * 4000 + ["vile1"])
    assert toxicity.Scorer(model).scores([late])[0] > toxicity.Scorer(model).scores([late[:-6]])[0]
    rows = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert toxicity.score(none, model).count() == 0 and toxicity.keep_clean(docs, model).columns == docs.columns


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in toxicity._start(3, rng).items()}
    x, mask, y = rng.normal(size=(5, 4, toxicity.WORDS + toxicity.CHARS)), np.arange(5)[:, None] < np.array([5, 3, 4, 1]), np.array([1.0, 0, 1, 0])
    _, g, dx = toxicity._loss_and_gradients(p, x, mask, y)
    for name, grad, at in [("wf", g["wf"], (2, 3)), ("uf", g["uf"], (1, 20)), ("ub", g["ub"], (4, 9)), ("wa", g["wa"], (3, 2)), ("wo", g["wo"], (5,)), ("x", dx, (0, 0, 7))]:
        own = x if name == "x" else p[name]
        losses = []
        for step in (3e-2, -6e-2):
            own[at] += step
            losses.append(toxicity._loss_and_gradients(p, x, mask, y)[0])
        own[at] += 3e-2
        assert abs((losses[0] - losses[1]) / 6e-2 - grad[at]) < 2e-3, name


def slow_score(model: toxicity.Model, text: str) -> float:
    """The network window by window and word by word, as the gates' formulas read."""
    words = toxicity.words_of(text)
    sig = lambda v: 1 / (1 + np.exp(-v))
    p, h, logits = {k: v.astype(np.float64) for k, v in model.p.items()}, toxicity.HIDDEN, []
    for a, b in toxicity.windows(len(words)):
        x = []
        for w in words[a:b]:
            ids, _ = toxicity.grams([w])
            x.append(np.concatenate([p["word"][model.vocab.get(w, 0)], p["char"][ids].mean(axis=0)]))
        states = {}
        for d in "fb":
            state, seen = np.zeros(h), []
            for v in x if d == "f" else x[::-1]:
                pre, rec = v @ p[f"w{d}"] + p[f"b{d}"], state @ p[f"u{d}"]
                reset, keep = sig(pre[:h] + rec[:h]), sig(pre[h : 2 * h] + rec[h : 2 * h])
                new = np.tanh(pre[2 * h :] + reset * rec[2 * h :])
                state = (1 - keep) * new + keep * state
                seen.append(state)
            states[d] = seen if d == "f" else seen[::-1]
        both = [np.concatenate(s) for s in zip(states["f"], states["b"], strict=True)]
        marks = np.array([np.tanh(s @ p["wa"] + p["ba"]) @ p["v"] for s in both])
        weight = np.exp(marks - marks.max()) / np.exp(marks - marks.max()).sum() if both else np.zeros(0)
        pooled = sum((w * s for w, s in zip(weight, both, strict=True)), np.zeros(2 * h))
        logits.append(pooled @ p["wo"] + p["bo"][0])
    best = sorted(logits, reverse=True)[: toxicity.BEST]
    return float(sig(np.array([max(logits), sum(best) / len(best), np.log(len(logits)), 1.0]) @ model.platt))


def test_scores_equal_a_plain_loop(toxic_model):
    texts = ["plain1 vile2 plain3", "", " ".join(f"plain{i % 60}" for i in range(75)) + " vile1", "Straße naïve 東京", "one"]
    got = toxicity.Scorer(toxic_model).scores(texts)
    assert np.allclose(got, [slow_score(toxic_model, t) for t in texts], atol=1e-4)


def test_samples_of_labels(spark):
    """Conflicting, repeated, null and held-out labels, and the bound of the sample."""
    docs = spark.createDataFrame([(i, f"plain{i % 7} text number{i % 5} " * 4) for i in range(400)] + [(None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, 1), (1, 1), (2, None), (3, 9), (None, 1), (5000, 1)], "doc_id long, toxic int")
    seen = {}
    real = toxicity.train
    toxicity.train = lambda texts, marks, **kw: seen.update(n=Counter(marks), prior=kw["prior"], texts=texts) or real([], [])
    try:
        toxicity.fit(docs, labels, rows=30)
    finally:
        toxicity.train = real
    assert seen["n"][1] <= 30 and 20 <= seen["n"][1] and seen["n"][0] <= 60 and None not in seen["texts"]
    usable = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    ones = sum(i % 4 == 0 or i == 1 for i in usable) + (zlib.crc32(b"5000") % 5 > 0)
    assert abs(seen["prior"] - ones / (len(usable) + (zlib.crc32(b"5000") % 5 > 0))) < 1e-9
    model = langid.fit(docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'aa', 'bb') as lang"), rows=50)
    assert model.langs == ["aa", "bb"]


def test_language_scores_equal_a_plain_mean(spark):
    model = langid.train([f"alpha beta gamma {i}" for i in range(40)] + [f"uno dos tres {i}" for i in range(40)], ["x"] * 40 + ["y"] * 40)
    for text in ("alpha dos", "a", "tres " * 500, "ÄÖ 東京"):
        ids, _ = langid.subwords([text])
        z = (np.mean([model.table[i].astype(np.float64) for i in ids], axis=0) + model.bias) / model.temperature
        assert np.allclose(model.probabilities([text])[0], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-6)


def test_language_of_held_out_texts(spark, docs, none):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(small)
    rows = langid.predict(small, model).join(small.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    got = langid.predict(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert next(r for r in got if r.doc_id == 4).lang_pred == "und" and langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(none)).collect()} == {"und"}


def test_fingerprints_of_edited_texts(spark, none):
    texts = {2: "abcdefgh", 5: None, 9: "zyxwv" * 9, 11: "abcdefgh", 40: ""}
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    ids = sorted(texts)
    for k, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        row = got[i]
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert row.fingerprint == fingerprint.fingerprint(own) and row.edited_fingerprint == fingerprint.fingerprint(edited)
        assert row.near_edited == fingerprint.likeness(row.fingerprint, row.edited_fingerprint) and 0 <= row.near_next <= 1
        assert row.same_edited == next((j for j, (a, b) in enumerate(zip(own, edited, strict=False)) if a != b), min(len(own), len(edited)))
    assert got[2].fingerprint == got[11].fingerprint and fingerprint.fingerprints(none).count() == 0


def test_equality_of_spans_and_extensions():
    rng = np.random.default_rng(12)
    texts = ["".join(rng.choice(list("ab東\0"), int(n))) for n in rng.integers(0, 60, 30)] + ["ab" * 40, "ab" * 39 + "a"]
    for _ in range(600):
        a, b = (texts[int(k)] for k in rng.integers(0, len(texts), 2))
        i, j, n = (int(x) for x in rng.integers(0, 25, 3))
        one, other = fingerprint.Prefix(a), fingerprint.Prefix(b)
        assert fingerprint.same_span(one, i, other, j, n) == (i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n])
        if i <= len(a) and j <= len(b):
            assert fingerprint.common_extension(one, other, i, j) == next((k for k, (x, y) in enumerate(zip(a[i:], b[j:], strict=False)) if x != y), min(len(a) - i, len(b) - j))
    for k, prime in enumerate(fingerprint.PRIMES):
        text = texts[0]
        own = fingerprint.Prefix(text)
        assert int(own.span(3, 9, k)) == sum((ord(c) + 1) * pow(fingerprint.BASE, e, prime) for e, c in enumerate(text[3:9])) % prime


def slow_print(text: str) -> str:
    """The fingerprint from its definition, span by span."""
    base, whole = fingerprint.BASE, ""
    for prime in fingerprint.PRIMES:
        whole += f"{sum((ord(c) + 1) * pow(base, e, prime) for e, c in enumerate(text)) % prime:08x}"
    slots, prime = [0xFFFFFFFF] * fingerprint.SLOTS, fingerprint.PRIMES[0]
    width = min(fingerprint.SPAN, len(text))
    for i in range(len(text) - width + 1 if text else 0):
        h = sum((ord(c) + 1) * pow(base, e, prime) for e, c in enumerate(text[i : i + width])) % prime
        h = (h * 2_654_435_761 & 0xFFFFFFFF) ^ (h >> 7)
        slots[h % fingerprint.SLOTS] = min(slots[h % fingerprint.SLOTS], h // fingerprint.SLOTS)
    return whole + "".join(f"{x:08x}" for x in slots)


def test_fingerprints_and_likeness_from_their_definition(spark):
    """Null and repeated ids, repeated ids with other texts, equal rows, clashing columns; the next row's likeness."""
    rows = [(None, "no id at all"), (None, None), (3, "some words in a row " * 4), (3, "other words of the same id"), (3, "some words in a row " * 4), (8, "some words in a row " * 3 + "end"), (9, "short"), (9, "short")]
    docs = spark.createDataFrame([(i, t, "k", "t", 1, True) for i, t in rows], "doc_id long, text string, key string, tie string, times int, carry boolean").repartition(4)
    got = Counter(tuple(r) for r in fingerprint.fingerprints(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "near_next").collect())
    hashed = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i is not None, i or 0, hashed[t or ""], t or "") for i, t in rows))
    want = Counter()
    for k, (has, i, _, text) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        cut = len(text) // 4
        a, b = slow_print(text), slow_print(following)
        pairs = [(x, y) for x, y in zip([a[16 + 8 * s : 24 + 8 * s] for s in range(fingerprint.SLOTS)], [b[16 + 8 * s : 24 + 8 * s] for s in range(fingerprint.SLOTS)], strict=True) if (x, y) != ("ffffffff", "ffffffff")]
        near = 1.0 if a == b else sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0
        want[i if has else None, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest(), a, near] += 1
    assert got == want


def test_copies_are_counted_before_they_are_dealt_out(spark):
    rows = [(None, "one text with no id")] * 700 + [(i, f"text {i}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = fingerprint.with_next(docs)
    assert dealt.where("key < 0 and not carry").count() <= 3 and dealt.where("key < 0 and not carry").agg({"times": "sum"}).first()[0] == 700
    assert fingerprint.fingerprints(docs).count() == 705


def test_many_ranges_give_each_row_its_next(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    rows = [(i * 3, f"text number {i} " * (i % 5 + 1)) for i in range(100)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for k, (i, text) in enumerate(rows):
        assert got[i] == hashlib.sha256(fingerprint.edit(text, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()
