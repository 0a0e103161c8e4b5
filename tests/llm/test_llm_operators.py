"""The operators against brute force, exact round trips and held-out cases."""

import random
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import encodings as en
from lodestrata.llm import entry, error_pages, leakage, near_duplicates, packing, page_template, repeated_lines, scanned_pages, sentences

WORDS = "museum archive page record garden harbour journal ledger mirror station student volume window yellow copper silver morning evening council library".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def test_near_duplicates(spark):
    rng, rows = random.Random(1), []
    for k in range(40):
        base = text(rng, 200).split()
        rows.append((len(rows), " ".join(base)))
        for edits in (3, 12, 30, 60):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = "changed" + str(rng.randrange(1000))
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000, rows[0][1]), (1001, rows[0][1] + " "), (1002, "too short")]
    sets = {}
    for i, t in rows:
        w = near_duplicates.tokens(t)
        if len(w) >= near_duplicates.MIN_TOKENS:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    true = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    docs = spark.createDataFrame(rows, "id long, body string")
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(docs, "id", "body").collect()}
    assert found == true
    groups = {r["id"]: r.group_id for r in near_duplicates.near_duplicate_groups(docs, "id", "body").collect()}
    assert all(groups[a] == groups[b] for a, b in true) and groups[1000] == 0 and 1002 not in groups


def test_many_copies(spark):
    rng = random.Random(2)
    same = text(rng, 150)
    rows = [(k, same) for k in range(100)] + [(500, same.replace("museum", "musee", 1))]
    found = {tuple(r) for r in near_duplicates.near_duplicate_pairs(spark.createDataFrame(rows, "id long, body string"), "id", "body").collect()}
    assert {(0, k) for k in range(1, 100)} | {(0, 500)} == found


def test_joined_path(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "FREQUENT_HELD", -1)
    test_near_duplicates(spark)


def test_suffix_array():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, 300)
    order, levels = repeated_lines.suffix_array(s, 16)
    naive = sorted(range(300), key=lambda k: (*s[k : k + 16].tolist(), -1))
    assert [tuple(s[k : k + 16]) for k in order] == [tuple(s[k : k + 16]) for k in naive]
    for a, b, n in list(zip(order[:-1], order[1:], repeated_lines.common_prefixes(order, levels), strict=True))[:200]:
        m = 0
        while a + m < 300 and b + m < 300 and s[a + m] == s[b + m]:
            m += 1
        assert min(n, 16) == min(m, 16)


def test_repeated_lines(spark, monkeypatch):
    monkeypatch.setattr(repeated_lines, "BATCH_LINES", 50)
    rng, rows = random.Random(4), []
    for k in range(200):
        lines = [rng.choice(["Home", "HOME!", "Share (3)", "©  2020 Site", "ab", "", "unique text " + "xyz"[k % 3] * (k + 1)]) for _ in range(8)]
        rows.append((k, f"https://{'www.' * (k % 2)}S{k % 3}.example:80/{k % 60}", "\n".join(lines)))
    urls = {}
    key = lambda u, x: (repeated_lines.site_of(u), repeated_lines.letters(x))
    for i, u, b in rows:
        for x in b.split("\n"):
            if len(repeated_lines.letters(x)) >= 3:
                urls.setdefault(key(u, x), set()).add(u)
    true = {(i, n) for i, u, b in rows for n, x in enumerate(b.split("\n"), 1) if len(urls.get(key(u, x), ())) >= 10}
    docs = spark.createDataFrame(rows, "id long, url string, body string")
    assert {tuple(r) for r in repeated_lines.repeated_lines(docs, "id", "url", "body").collect()} == true and true


def test_wu_manber():
    rng = np.random.default_rng(5)
    passages = [(k, rng.integers(1, 30, 40).astype(np.uint64)) for k in range(20)]
    stream = rng.integers(1, 30, 5000).astype(np.uint64)
    for k in range(20):
        at = int(rng.integers(0, 4950))
        stream[at : at + 13] = passages[k][1][5:18]
    ends, items = leakage.WuManber(13, passages).search(stream)
    true = set()
    windows = {tuple(p[j : j + 13].tolist()): k for k, p in passages for j in range(28)}
    for e in range(12, len(stream)):
        k = windows.get(tuple(stream[e - 12 : e + 1].tolist()))
        if k is not None:
            true.add((e, k))
    assert set(zip(ends.tolist(), items.tolist(), strict=True)) == true and true


def test_leaks_by_letter(spark):
    passage = "トルグレの珍しい写本はスルベクの記録を残している。すべての果樹園は写された。"
    docs = spark.createDataFrame([(1, "前に、" + passage.replace("。", " ") + "後"), (2, passage[:25]), (3, None)], "id long, t string")
    items = spark.createDataFrame([(9, "ja-JP", passage)], "item_id long, lang string, passage string")
    assert [tuple(r) for r in leakage.leaked(docs, "id", "t", items).collect()] == [(1, 9)]


def test_encoding_chains():
    truth = "Größere Lücken schließt das Straßenschild für Händler und Müller übermäßig schön täglich gehört wäre führte Prüfheft Gästebuch".split()
    russian = "Заметки о городском архиве музей хранит старый журнал каждый список подвал реестр северный театр дневник указатель".split()
    model = en.Model.fit(Counter({w: 9 for w in truth + russian}))
    good = model.verdicts([w for w in truth + russian if not w.isascii()])
    assert not any(v[1] for v in good.values())
    for chain, words in [((("utf-8", "cp1252"),), truth), ((("utf-8", "cp1252"), ("utf-8", "cp1252")), truth), ((("utf-8", "cp437"),), truth), ((("cp1252", "cp437"),), truth), ((("cp1251", "koi8_r"),), russian), ((("utf-8", "cp1251"),), russian)]:
        t = " ".join(words)
        g = en.garble(t, chain)
        assert en.restore(g, chain) == t
        verdicts = model.verdicts([en.plain(w) for w in en.odd_words(g)])
        found, chains = en.judge(g, verdicts)
        fixed = en.repair(g, verdicts, chains)
        assert found and sum(a == b for a, b in zip(fixed.split(), words, strict=True)) >= 0.9 * len(words), chain
    quoted = "Die Zeichen Ã¼ und Ã¶ im Protokoll"
    assert not en.judge(quoted, model.verdicts(en.odd_words(quoted)))[0]
    assert en.judge("verl�ssliche", {})[0]


def page(rng, k, body):
    return "\n".join(["Home | News | Contact", f"You are here: Home > Story {k}", f"Story {k} of {rng.choice(WORDS)}", f"by Dr. {rng.choice(WORDS).title()}, 2020-01-0{k % 9 + 1}", *body, "Share this page", "Most read", f"The {rng.choice(WORDS)} of {rng.choice(WORDS)} ({k})", f"© 20{k % 20 + 10} The Site. All rights reserved."])


def sentence(rng):
    return "The " + " ".join(rng.choice(WORDS) for _ in range(30)) + " closed before noon, and nobody knew why it did so. It opened again later."


def test_templates_and_errors(spark):
    rng, rows, errors = random.Random(6), [], set()
    for k in range(300):
        if k % 15 == 0:
            errors.add(k)
            body = [rng.choice(["Page not found", "Internal server error"]), "Please try again later or go back."]
        elif k % 7 == 0:
            body = ["The " + " ".join(rng.choice(WORDS) for _ in range(9)) + " closed before noon."]
        else:
            body = [sentence(rng) for _ in range(4)]
            if k % 5 == 0:
                body.append("When the server said “Page not found”, the librarian printed the ledger and went home for the day, as the custom had been for years.")
        rows.append((k, f"http://h{k % 4}.example/{k}", page(rng, k, body)))
    docs = spark.createDataFrame(rows, "id long, url string, body string")
    bad = spark.createDataFrame([(k,) for k in errors if k % 2 == 0], "id long")
    found = {r[0] for r in error_pages.error_pages(docs, bad).collect()}
    assert len(found & errors) >= 0.9 * len(errors) and len(found - errors) <= 2
    lines = {tuple(r) for r in page_template.boilerplate_lines(docs, "id", "url", "body").collect()}
    hits = wrong = total = 0
    for i, _, b in rows:
        own = b.split("\n")
        for n, x in enumerate(own, 1):
            furniture = n <= 2 or n > len(own) - 4
            total += furniture
            hits += furniture and (i, n) in lines
            wrong += not furniture and (i, n) in lines
    assert hits >= 0.95 * total and wrong <= 0.02 * total


def test_tree_matching():
    rng = random.Random(7)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(12)] for _ in range(2))
        places = {}
        for p in range(len(b) - 1, -1, -1):
            places.setdefault(b[p], []).append(p)
        best = [[0] * 13 for _ in range(13)]
        for i in range(12):
            for j in range(12):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
        assert len(page_template.tree_matching(a, places)) == best[12][12]


def test_levenshtein():
    words = ["garden", "harbour", "journal", "gardens", "warden", "guard"]
    got = dict(scanned_pages.Trie(words).within("garden", 2))
    assert got == {"garden": 0, "gardens": 1, "warden": 1}


def test_scanned_pages():
    words = {w: 200 for w in WORDS} | {"well-kept": 50, "the": 900, "The": 900, "of": 900, "handwritten": 90}
    lexicon = scanned_pages.Lexicon(words, {})
    body = "The museum of the handwrit-\nten archive, the well-\nkept jonrnal of the garden.\n\nDigitalisiert in X\n12\fRunning Header of the Book    13\nThe library of the museum.\nDigitalisiert in X\n13"
    flaws, fixed = scanned_pages.judge(lexicon, "The har- bour", body)
    assert {f for f in flaws} == {(1, "split"), (3, "misread"), (5, "furniture"), (6, "furniture"), (7, "furniture"), (9, "furniture"), (10, "furniture"), (0, "split")}
    assert "handwritten archive, the well-kept journal" in fixed and "Digitalisiert" not in fixed


def test_packing(spark):
    rng = random.Random(8)
    sizes = [(k, rng.choice([rng.randrange(1, 500), rng.randrange(1, 90), rng.randrange(500, 3000)])) for k in range(3000)] + [(9000, 0), (None, 5)]
    rows = packing.pack(spark.createDataFrame(sizes, "id long, tokens long"), [(1, 512), (2, 2048)]).collect()
    for spec, capacity in ((1, 512), (2, 2048)):
        own = [r for r in rows if r.spec_id == spec]
        fill, whole, pieces = Counter(), Counter(), Counter()
        for r in own:
            fill[r.container] += r.tokens
            whole[r["id"]] += r.tokens
            pieces[r["id"]] += 1
        assert max(fill.values()) <= capacity
        assert dict(whole) == {k: n for k, n in sizes if n and k is not None}
        assert all(pieces[k] == -(-n // capacity) for k, n in sizes if n and k is not None)
        assert sum(whole.values()) / (len(fill) * capacity) > 0.97


def test_crossover_keeps_items():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 100, 200)
    a, b = (packing._fit(sizes, rng.permutation(200), 128) for _ in range(2))
    for child in (packing.crossover(a, b, sizes, 128, rng), packing.mutate(a, sizes, 128, rng)):
        assert len(child) == 200 and np.bincount(child, sizes).max() <= 128


CASES = [
    "Heading here\n\n“Who kept the printer?” asked the people of Oldtown. |The library, cf. vol. 3, opens at 9 a.m. and closes at 5 p.m. at noon. |Did it close at 5 p.m.? |(See the record, p. 12.) |Yes!",
    "Das Register (vgl. Bd. 5, S. 7) enthält z. B. Birnen usw. |Am 3. Mai 1911 öffnete Prof. J. K. Müller das Haus unter Nr. 309. |Größere Lücken … oder was blieb.",
    "« Qui gardait le fichier ? » demanda-t-on à Paris. |M. Dupont vint, c.-à-d. tard. |Le prix est de 3,5 euros par an!! |Fin",
    "«сборник пропал!» — крикнул Моняня из подвала. |В 1952 г. для города купили сад (см. т. 6, с. 7). |Конец",
    "「完全な写本は残っていない。」とフェの人は言った。|約88.82パーセントだ！|なぜか？",
    "“新的索引不见了！”文法的人喊道。|每份都复制到www.x.test。|多么完整的图像啊！",
    "“सर्वर कहाँ है?” दानमारी ने पूछा। |डॉ. रिल ने 2018 में रखा था।",
    "«ضاع السجل!» قال مارلومفال بصوت عال. |كتب د. فين عن الخادم. |من حفظ التقرير؟ |نعم",
    "ดัชนีใหม่ของมารี |ในปี 1970 ห้องสมุดสูญหายไป 813 หน้า |คัดลอกไว้ที่ a.test แล้ว",
    "Ποιος φύλαγε το μητρώο; |«Χάθηκε το αρχείο!» φώναξε Βοκι. |Τέλος, π.χ. από το μουσείο.",
    "first item. |all in small letters, prof. x came. |really? |yes",
]


@pytest.mark.parametrize("case", CASES)
def test_sentences(spark, case):
    plain = case.replace("|", "")
    want = [x.strip() for part in case.split("\n\n") for x in part.split("|")]
    rows = sentences.sentence_units(spark.createDataFrame([(1, plain)], "id int, t string"), "id", "t").orderBy("start_char").collect()
    assert [plain[r.start_char : r.end_char] for r in rows] == want


def test_sentence_lists(spark):
    t = "Intro line\ngoes on.\n- first point\n• second 😀 one\n3. third\n\n  Last"
    rows = sentences.sentence_units(spark.createDataFrame([(1, t)], "id int, t string"), "id", "t").orderBy("start_char").collect()
    assert [t[r.start_char : r.end_char] for r in rows] == ["Intro line\ngoes on.", "- first point", "• second 😀 one", "3. third", "Last"]


def test_every_problem_has_queries():
    for n in range(1, 10):
        assert any(k.startswith(f"p{n}_") for k in entry.QUERIES)
