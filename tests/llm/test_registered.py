"""The registered queries without SQL twins, over whole tables with planted rows, against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib

from trailwarden.llm import licences
from trailwarden.llm.common import table
from trailwarden.llm.queries import all_queries

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ORDER = ("assign", "access", "hex")


def planted(spark, folder, name, rows):
    """The given table and some rows more, as a folder that a query can read."""
    base = table(spark, SF, name)
    more = spark.createDataFrame(rows, base.schema)
    base.unionByName(more).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, tmp_path):
    rng = random.Random(5)
    sign = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"
    value = lambda n: "".join(rng.choice(sign) for _ in range(n))
    plain = [r.text for r in table(spark, SF, "documents").where("length(text) > 400").orderBy("doc_id").limit(40).collect()]
    cases, rows = {}, []
    for k, text in enumerate(plain):
        secret, cut = value(rng.choice((20, 28, 40))), text.find(" ", 200)
        cue = rng.choice(("Authorization: Bearer ", "pwd: ", "passphrase = ", "private key: ", "login: "))
        where = cut + 1 + len(cue)
        cases[900_000 + k] = (where, where + len(secret))
        rows.append((900_000 + k, f"{text[:cut]} {cue}{secret}{text[cut:]}", "en", "planted", 0))
    rows += [(None, "", "en", None, 0), (910_000, None, None, None, None), (910_001, 'token="abcdef1"', "en", "a", 15)]
    schema = table(spark, SF, "documents").columns
    folder = planted(spark, tmp_path, "documents", [tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)).get(c) for c in schema) for r in rows])
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    got = all_queries()["op2_secrets"](spark, folder).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, texts))
    hit = wrong = 0
    for r in got:
        want = base_spans(texts[r.doc_id])
        spelt = [f"{ORDER[k]}:{a}:{b}" for a, k, b in want]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(spelt).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("crf")] == spelt
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
        added = [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("crf")]
        hit += cases.get(r.doc_id) in added
        wrong += sum(s != cases.get(r.doc_id) for s in added)
    # the base patterns find none of the planted ones
    assert hit >= 0.9 * len(cases) and wrong <= 0.05 * len(cases), (hit, wrong)


def test_toxicity_on_held_out_labels(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, LARGER, "labels").collect()}
    got = all_queries()["op6_toxicity"](spark, LARGER).collect()
    assert len(got) == table(spark, LARGER, "documents").count()
    found, flagged = {0: 0, 1: 0}, {0: 0, 1: 0}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        if r.held_out and r.doc_id in labels:
            found[labels[r.doc_id]] += 1
            flagged[labels[r.doc_id]] += r.predicted
    assert flagged[1] >= 0.75 * found[1] > 0 and flagged[0] <= 0.02 * found[0], (found, flagged)


def article_text(page):
    """The given pages hold one article each, of headings and paragraphs."""
    inside = re.search(r"<article\b[^>]*>(.*)</article>", page, re.S)[1]
    inside = re.sub(r"<!--.*?-->|<(script|style|aside|form|nav)\b.*?</\1>|<div class=\"ad\">.*?</div>", "", inside, flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|table|tr|blockquote|section|pre|figure|figcaption)\b[^>]*>", inside)
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_page_text(spark, tmp_path):
    long = "A sentence of the story that goes on for quite a while, with commas and all. " * 3
    bare = "".join(f"<div><p>{i} {long}</p></div>" for i in range(5))
    rows = [
        (800_001, "http://a.example/1", f"<html><body><div id='menu'><a href='/'>Home</a></div>{bare}<footer>end</footer></body></html>"),
        (800_002, "http://a.example/2", None), (800_003, None, ""), (None, "http://a.example/4", f"<article><p>one&nbsp;&amp; {long}</p></article>"),
    ]
    columns = table(spark, SF, "pages").columns
    folder = planted(spark, tmp_path, "pages", [tuple(dict(zip(("page_id", "url", "html"), r))[c] for c in columns) for r in rows])
    story = " ".join(long.split())
    special = {800_001: "\n".join(f"{i} {story}" for i in range(5)), 800_002: "", 800_003: "", None: f"one & {story}"}
    pages = {r.page_id: r for r in table(spark, folder, "pages").collect()}
    got = all_queries()["op7_page_text"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        want = special[r.page_id] if r.page_id in special else article_text(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def expression(template):
    """A template as a regular expression over words with a blank behind each."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[a-z0-9]+", template):
        if part in ("[[", "]]"):
            out += "(?:" if part == "[[" else ")?"
        else:
            out += f"(?:[^ ]+ ){{0,{part[2:-2]}}}" if part.startswith("{{") else f"{part} "
    return re.compile("(?:^| )" + out)


def test_licences(spark, tmp_path):
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "This software is licensed under the terms of the GNU General Public License, version 2. All rights reserved, CC BY.",
        "Released under an MIT License", "\U0001f600 all rights reservedé", "", None, "This is free and unencumbered software released into the public domain.",
    ]
    columns = table(spark, SF, "documents").columns
    rows = [dict(doc_id=700_000 + k, text=t, lang="en", source="planted", n_chars=0) for k, t in enumerate(texts)]
    folder = planted(spark, tmp_path, "documents", [tuple(r.get(c) for c in columns) for r in rows])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    templates = {label: expression(t) for label, t in licences.TEMPLATES.items()}
    held = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    got = {r.doc_id: r for r in all_queries()["op9_licences"](spark, folder).collect()}
    assert set(got) == set(held)
    for i, text in held.items():
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        base, line = {label for _, label in places}, "".join(f"{w} " for w in words)
        more = {label for label, e in templates.items() if e.search(line)}
        starts = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(base)), ",".join(sorted(base | more)))
        assert r.score == (1.0 if more else licences.BASE_ONLY if base else 0.0)
    assert [got[700_000 + k].labels for k in (0, 2, 6)] == ["bsd-clause", "", "unlicense"]
