import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.llm import body, furniture, groups, leakage, packing, residue, spam, splitting, templates
from webloom.llm.residue import judge_page
from webloom.llm.tokens import DEFAULT_TOKENIZER, ByteBpe
from webloom.schemas import PAGE_LINKS, PAGES


def pages_of(spark, rows):
    """rows: (id, domain, title, text)"""
    return spark.createDataFrame([(i, 1, "u", "u", d, t, None, None, x, 200, 0, None, None, 0, 1, None) for i, d, t, x in rows], PAGES)


PROSE = "The crawler stores every page before the index is updated, so a restart loses nothing. We measured ten requests per second after the cache was added to the first server."


# p1


def test_wordings():
    tree = templates.TemplateTree()
    text = "Posted on 7 February 2025\nposted ON: 2025-03-01!\n\nShare “My page” by mail\nRead more on caching\n12\nMy page"
    ids = templates.line_templates(text, "My page", tree)
    # a month between numbers may be a value: the slotted templates of both notations of it are one
    other = templates.line_templates("posted on 11. März 2024", None, tree)[0]
    assert ids[0][0] != other[0] and ids[0][1] == other[1] is not None and ids[1] == templates.line_templates("Posted on 7/2/25", None, tree)[0]
    assert ids[2] == ids[5] == ids[6] == (None, None)
    assert ids[3] == templates.line_templates("share Other title by mail.", "Other title", tree)[0]
    assert ids[4] != templates.line_templates("Read more on storage", "x", tree)[0]


def test_slots_are_learned_and_merged(spark):
    months = ["enero", "febrero", "marzo", "abril", "mayo"]
    rows = [(i, "a.example", f"T{i}", f"Publicado el {i + 1} de {months[i % 5]} de 2024\n{i + 1} words by {i + 2} readers") for i in range(5)]
    # framed words that are always the same stay literal; two fillings are no wildcard
    rows += [(10 + i, "b.example", f"T{i}", f"Stand {i + 1} {'mai' if i % 2 else 'juni'} 2024") for i in range(6)]
    rows += [(20, "a.example", "x", "3 hosts by 4 readers")]
    pages = pages_of(spark, rows)
    parsed = templates._parsed(pages.repartition(7))
    assert templates.merged_slots(parsed).count() == 1
    got = {(r.page_id, r.line_no) for r in templates.repeated_lines(pages).collect()}
    # without the slots each date would be a wording of its own
    assert got == {(i, n) for i in range(5) for n in (1, 2)}
    assert templates.framed("0 de x de 0 a b c d 0 e 0 0".split()) == [1, 2, 3, 10]


def test_heading_below_a_long_menu():
    tree = templates.TemplateTree()
    menu = "\n".join(f"Menu {w}" for w in "abcdefghijklmno")
    prompt = lambda heading, title: templates.line_templates(f"{menu}\n{heading}\nShare “{heading}” by mail", title, tree)[-1]
    # no title, or one that is no line of the page: the heading is found wherever it stands
    assert prompt("How caches work today", None) == prompt("Why the indexes grow", "Acme blog") == prompt("Notes on old servers", "Notes on old servers")


def test_repeated_lines(spark):
    rows = [(i, "A.example" if i % 2 else "a.example", f"Title {i} x", f"Accept cookies\r\nText {'abcdefgh'[i]} only here\n{i} comments") for i in range(1, 7)]
    rows += [(7, "a.example", None, None), (8, "a.example", None, ""), (9, None, "t", "Accept cookies"), (10, "b.example", "t", "Accept cookies")]
    pages = pages_of(spark, rows)
    got = {(r.page_id, r.line_no) for r in templates.repeated_lines(pages).collect()}
    assert got == {(i, n) for i in range(1, 7) for n in (1, 3)}
    left = {r.id: r.extracted_text for r in templates.remove_repeated_lines(pages).collect()}
    assert left[1] == "Text b only here" and left[7] is None and left[8] == "" and left[10] == "Accept cookies"
    assert templates.repeated_lines(pages.limit(0)).count() == 0


# p2


def test_groups_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(500, k) for k in range(501, 530)]
    pairs += [(7, 7), (None, 3), (900, None), pairs[0], (pairs[1][1], pairs[1][0]), (999, 999)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(a, b, "x") for a, b in pairs], "a bigint, b bigint, group_id string")
    got = [tuple(r) for r in groups.consolidate_pairs(df, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(find(x), x) for x in parent}
    assert groups.consolidate_pairs(df.limit(0), "a", "b").count() == 0


# p3, p4, p6


WORDS = "server cache index page query crawler queue host reader table".split()


def site_pages(name: str, pages: int, seed: int) -> list[tuple]:
    """(domain, url, title, text): a menu, the article with a list of its own, a list of other articles, a footer."""
    r = random.Random(seed)
    pick = lambda: r.choice(WORDS)
    made = lambda: "".join(r.choice(["ka", "lo", "mi", "ru", "te", "sno"]) for _ in range(4))
    sentence = lambda: f"The {pick()} keeps every {pick()} of the {pick()} before the {pick()} is updated, so the old {pick()} loses nothing when it is moved."
    heading = lambda: f"How one {pick()} moves {made()} to the {pick()}s"
    out = []
    for i in range(pages):
        title = f"Notes on the {pick()} and the {pick()} {i}"
        own = [f"- Why the {pick()} needs {made()}" for _ in range(3)] if i % 2 else []
        lines = ["Home", "Docs", "Pricing", title, f"By the {name} team on 2024-03-{i % 27 + 1:02}", sentence() + " " + sentence(), *own, sentence() + " " + sentence(), f"## {heading()}", sentence() + " " + sentence()]
        lines += ["Related articles", *[heading() for _ in range(3)], f"Previous article: {heading()}", f"© 2020 {name}. All rights reserved."]
        out.append((f"{name.lower()}.example", f"https://{name.lower()}.example/p/{i}", title, "\n".join(lines)))
    return out


NAMES = ["Acme", "Borel", "Carlin", "Dorset", "Elgin", "Farrow"]
CORPUS = [p for k, n in enumerate(NAMES) for p in site_pages(n, 20, k)]
BODY = body.fit_body_model(CORPUS)


def judged(name: str, title: str | None, text: str) -> list[int]:
    return furniture.furniture_of(BODY, f"{name.lower()}.example", None, title, text)


def test_furniture_of_a_site_not_seen():
    title = "Notes on the restart of one server"
    own = "- Why the server needs lomisno\n- Why the cache needs teruka"
    text = f"Home\nDocs\n{title}\nBy the Zorin team on 2021-02-03\n{PROSE}\n{own}\n{PROSE}\n\nRelated articles\nHow one queue moves kateru to the hosts\nHow one page moves milosno to the caches\n© 2019 Zorin. All rights reserved."
    assert judged("Zorin", title, text) == [1, 2, 4, 10, 11, 12, 13]
    # the title is known from the URL too
    found = furniture.furniture_of(BODY, "zorin.example", "https://zorin.example/a/notes-on-the-restart-of-one-server-x1", None, text)
    assert found == [1, 2, 4, 10, 11, 12, 13]


def test_furniture_held_out():
    # sites held out of the fit: the article's lines are kept, all others found
    model = body.fit_body_model([p for p in CORPUS if p[0] not in ("elgin.example", "farrow.example")])
    hits = found = cases = 0
    for domain, url, title, text in CORPUS[80:]:
        lines = text.split("\n")
        last = max(k for k, x in enumerate(lines, 1) if x.startswith("The "))
        true = {k for k in range(1, len(lines) + 1) if k <= 3 or k == 5 or k > last}
        got = set(furniture.furniture_of(model, domain, url, title, text))
        hits, found, cases = hits + len(true & got), found + len(got), cases + len(true)
    assert hits >= 0.95 * found and hits >= 0.95 * cases


def test_region():
    assert body.best_region([-3.0, 4.0, -1.5, 6.0, -20.0, 5.0]) == (1, 3) and body.best_region([-1.0, 0.0]) == (0, -1)
    # without labels nothing can be told apart
    assert body.fit_body_model([]).judge(None, None, None, "Home\nx")[0].kind == body.OWN
    assert body.fit_body_model([("a", None, None, "x\ny")]).judge("a", None, None, "x")[0].kind == body.OWN
    # what is remembered of earlier pages changes nothing
    fresh = body.BodyModel(BODY.local, BODY.context)
    assert [[x.kind for x in fresh.judge(*p)] for p in CORPUS[:9]] == [[x.kind for x in BODY.judge(*p)] for p in CORPUS[:9]]


def test_equal_lines_are_fitted_once(monkeypatch):
    told = []
    features = body.local_features
    monkeypatch.setattr(body, "local_features", lambda *line: told.append(line) or features(*line))
    model = body.fit_body_model(CORPUS)
    # what stands on page after page is numbered once, whatever the number of pages and rounds
    assert len(told) <= len({x.strip() for p in CORPUS for x in p[3].split("\n")})
    assert model.rows[0][""] == sum(1 for p in CORPUS for x in p[3].split("\n") if x.strip()) and model.local == BODY.local


def test_equal_rows_and_columns_of_a_fit():
    import numpy as np

    rows, place = [(), ("a", "b", "c"), ("a", "d"), ("a",)], [1, 2, 1, 0, 3, 2, 1]
    labels, strengths = np.array([1.0, 0.0, 1.0, 0.5, 0.3, 0.0, 0.8]), np.array([1.0, 1.0, 0.5, 0.0, 0.3, 1.0, 0.4])
    held, each = body.Encoded(rows, place, 2), body.Encoded([rows[k] for k in place], range(7), 2)
    one, other = held.fit(labels, strengths), each.fit(labels, strengths)
    assert held.counts == each.counts == {"a": 6, "b": 3, "c": 3, "d": 2, "": 7} and set(one) == set(other) == {"", "a", "b", "c", "d"}
    assert all(abs(one[f] - other[f]) < 1e-9 for f in one) and one["b"] == one["c"] and np.allclose(held.scores, each.scores)
    assert body.Encoded([()], [0, 0], 2).fit(np.ones(2), np.ones(2)).keys() == {""}


def test_many_lines_at_once(spark):
    lines = ["Posted on 7 February 2025, see /a/b/c or v2.5", "(Étés) d'hiver: x", "a bb ccc", "may 3 be", "𝒳𐐷 ab", "", "— 12 %"]
    counted = sum((Counter(residue.words_of(x)) for x in lines), Counter())
    assert residue.count_words(lines) == counted and residue.count_words([]) == Counter()
    grams = sum((Counter({g: n for g in [*residue._grams(w)]}) if len(set(residue._grams(w))) == len(residue._grams(w)) else Counter(residue._grams(w) * n) for w, n in counted.items()), Counter())
    assert residue.grams_of(counted) == grams and residue.grams_of(Counter()) == Counter()
    # kinds told of many lines are those told of each, and pages passed over have no reason
    pages = corpus_pages(spark)
    body_model, model = residue.fit_models(pages)
    rows = [(r.domain, r.normalized_url, r.title, r.extracted_text) for r in pages.collect()] + [("a.example", None, "x", PROSE + "\nDear {{name}}, thank you for choosing {{company}}!"), (None, None, "{{tagline}}", PROSE), (None, None, None, None)]
    every = {x.strip() for r in rows if r[3] for x in r[3].split("\n")}
    alone = {x: model._residue(x) for x in every if x}
    model.prepare(every)
    assert any(alone.values()) and {x: model.residue(x) for x in alone} == alone
    may = [residue.may_be_residue(r[2], r[3], model) for r in rows]
    assert not all(may) and may[-3:] == [True, True, False]
    assert all(m or judge_page(*r, body_model, model)[:2] == (None, 0.0) for m, r in zip(may, rows))


def corpus_pages(spark):
    """The sites' pages, 40 pages of an error status, and 20 that speak of fields."""
    rows = [(i, 1, u, u, d, t, None, None, x, 200, 0, None, None, 0, 1, None) for i, (d, u, t, x) in enumerate(CORPUS)]
    for i in range(40):
        d, u, t, _ = CORPUS[3 * i]
        rows.append((1000 + i, 1, u, u, d, "Error", None, None, f"Home\nDocs\nSorry, the page /a/b{i} does not exist.\nService temporarily unavailable: backend {i}x did not answer.", 404, 0, None, None, 0, 1, None))
        said = f"{PROSE}\nIn one block of the server, write '{{{{name{i}}}}}' where the value of the page should be filled in, as others do.\n{PROSE}"
        rows.append((2000 + i, 1, u, u, d, t, None, None, said, 200, 0, None, None, 0, 1, None))
    return spark.createDataFrame(rows, PAGES)


def test_residue_judgements(spark):
    pages = corpus_pages(spark)
    models = residue.fit_models(pages)
    reason = lambda title, text: judge_page("acme.example", None, title, text, *models)[0]
    assert reason("{{tagline}} | Acme", PROSE) == "field"
    assert reason("x", PROSE + "\nDear {{name}}, thank you for choosing {{company}}!") == "field"
    assert reason("x", PROSE + "\nFragen zu {{name}}? Schreiben Sie an {{company}}.") == "field"
    assert reason("Writing {{name}} in templates", PROSE + "\nIn one block of the server, write '{{name}}' where the value should be filled in.") is None
    assert reason("x", PROSE + "\nIn one block of the cache, write {{name}} where the value of the page should be filled in.") is None
    assert reason("x", PROSE + "\n$ render --name {{name}}") is None
    assert reason("x", "Home\nSorry, the page /q/z9 does not exist.\n© 2020 Acme. All rights reserved.") == "residue"
    assert reason("x", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor. " * 3) == "residue"
    assert reason("x", PROSE) is None and reason(None, None) is None and reason(None, "  \n") is None
    # an error status says nothing about the page itself
    found = {r.page_id: r.reason for r in residue.residue_pages(pages).collect()}
    assert set(found) == set(range(1000, 1040)) and set(found.values()) == {"residue"}


def test_models_are_fitted_to_all_pages(spark):
    # the last of the error pages by the hash of their ids says what no other says
    ids = [r.id for r in spark.range(5000, 7300).orderBy(F.xxhash64("id")).collect()]
    rows = []
    for k, i in enumerate(ids):
        d, u, t, _ = CORPUS[k % len(CORPUS)]
        said = "Quuxel vorbling zanthrip kelmory dwindax frobnet." if i == ids[-1] else f"Sorry, the page /a/b{i % 50} does not exist."
        rows.append((i, 1, u, u, d, "Error", None, None, f"Home\nDocs\n{said}", 404, 0, None, None, 0, 1, None))
    pages = corpus_pages(spark).unionByName(spark.createDataFrame(rows, PAGES))
    _, model = residue.fit_models(pages)
    assert model.residue("Quuxel vorbling zanthrip kelmory dwindax frobnet.") == 1
    placed, count = residue.shards(pages, 100, 7)
    assert count >= 20 and placed.count() == pages.where("extracted_text <> ''").count() and placed.groupBy("shard").count().count() > count / 2
    _, model = residue.fit_models(pages, shard_pages=700)
    assert model.residue("Quuxel vorbling zanthrip kelmory dwindax frobnet.") == 1 and model.residue(PROSE) == 0


def test_page_queries(spark):
    stuffed = ", ".join(random.Random(1).choices(["buy lamps", "lamps", "cheap lamps", "lamps deals"], k=80))
    pages = corpus_pages(spark).unionByName(pages_of(spark, [(100_000, "acme.example", "lamps", stuffed), (100_002, "acme.example", None, None), (100_003, None, "", ""), (None, "acme.example", "x", PROSE)]))
    links = spark.createDataFrame([(1, 1, 100_000, "https://x.example/", None, 1, False), (2, 1, None, None, None, 1, None)], PAGE_LINKS)
    assert [r.page_id for r in spam.spam_pages(pages, links).collect()] == [100_000]
    left = {r.id for r in residue.exclude_residue(pages).collect()}
    assert 1001 not in left and {None, 100_002} <= left
    assert furniture.furniture_lines(pages).where("page_id in (100002, 100003)").count() == 0
    bodies = {r.page_id: r.body for r in furniture.main_bodies(pages).collect()}
    assert bodies[100_002] is None and bodies[100_003] == "" and "Home" not in bodies[0]
    for empty in (residue.residue_pages(pages.limit(0)), furniture.furniture_lines(pages.limit(0)), spam.spam_pages(pages.limit(0), links)):
        assert empty.count() == 0


def test_language_of_keywords():
    def line(text, sentence):
        x = body.Line(text, len(text.split()), body.OWN, sentence, "", "", 0.0)
        x.cuts = body.tokens_of(text, ""), sentence
        return x

    keywords = "Lampen günstig, Lampen kaufen, Lampen Angebot"
    assert spam.measures([line(keywords, False)], f"Über uns und die Produkte\n{keywords}\nDiese Seite ist mit Liebe gemacht")[0] == "de"
    assert spam.measures([line(PROSE, True)], "der die das und ist " * 9)[0] == "en"
    assert all(spam.is_code(body.tokens_of(x, "")) for x in ("GET /users/items?page=3", "Acme | late | 31 | hosts", "x.cache = open(host, limit=2)"))
    assert not spam.is_code(body.tokens_of("buy lamps | cheap lamps online | lamps", ""))


def test_lines_of_words_alone_are_no_code(monkeypatch):
    asked = []
    monkeypatch.setattr(spam, "is_code", lambda tokens: asked.append(tokens) or True)
    lines = [body.Line(x, len(x.split()), body.OWN, False, "", "", 0.0, (body.tokens_of(x, ""), False)) for x in ("cheap lamps online", "x.cache = open(host, limit=2)")]
    _, words, sure, *_ = spam.measures(lines)
    # their tokens are all letters, and are not gone through again
    assert asked == [lines[1].cuts[0]] and sure == lines[1].words / words


def test_many_pages_are_measured_at_once(monkeypatch):
    r = random.Random(5)
    odd = ["", " \t ", "a\tb  c", "Étés — ﬁn ２０２４", "May 3, 2024 | acme", "Acmes acmex ACME 12 acm", "x.cache = open(host, limit=2)", "see https://a.example/x?y=1 or www.b.example now", "“the quoted words” of it", "in\u2028two", "ab\u200bc", "- - -", "=", "·", PROSE, PROSE.replace(" ", "\x85 ", 1), "7 mars — 8 mai 0 mars", "der die das", "𝒳 x²"]
    pages = [("www.acme.example", p[1], p[2], p[3] + "\n" + "\n".join(r.choices(odd, k=6))) for p in CORPUS]
    pages += [(r.choice([None, "", "ab.example", "acme2.example"]), r.choice([None, "https://a.example/a/acmes-acmex-acme-of-it"]), r.choice([None, "", "acmes acmex", "=="]), "\n".join(r.choices(odd, k=k % 7))) for k in range(60)]
    for model in (BODY, body.BodyModel({"": 0.0}, {"": 0.0})):
        alone = [model.judge(*p) for p in pages]
        measured = [spam.measures([x for x in lines if x.kind == body.OWN], p[3]) for p, lines in zip(pages, alone)]
        with monkeypatch.context() as only:
            # no line is read by itself
            only.setattr(body, "tokens_of", None)
            only.setattr(model, "read", None, raising=False)
            many, _ = model.judge_many(pages)
            at_once = spam.measures_many(pages, model)
        told = [[(x.text, x.words, x.kind, x.sentence, x.bullet, x.key, x.signs, x.begins, x.known, round(x.base, 9)) for x in lines if x.kind != body.BLANK] for lines in (*alone, *many)]
        assert told[: len(pages)] == told[len(pages) :]
        assert all(a[:2] == b[:2] and max(abs(x - y) for x, y in zip(a[2:], b[2:])) < 1e-9 for a, b in zip(measured, at_once))
    assert spam.measures_many([], BODY) == []


def test_lines_that_cannot_cover_a_page_are_not_judged(monkeypatch):
    judge, pages = residue.ResidueModel._residue, [(p[0], p[1], p[2], f"{p[3]}\nThis page could not be found. The page was not found.", 200) for p in CORPUS]
    pages += [("gone.example", None, None, "This page could not be found. The page was not found. Not Found.", 404)] * 30
    asked = []
    monkeypatch.setattr(residue.ResidueModel, "_residue", lambda model, line: asked.append(line) or judge(model, line))
    assert residue.fit_shard(pages) and set(asked) == {"This page could not be found. The page was not found. Not Found."}


# p7


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_sum_of_squares(sizes):
    bins, levels = packing.sum_of_squares(sizes, 20)
    filled = [0] * len(levels)
    for s, b in zip(sizes, bins):
        filled[b] += s
    assert filled == levels and all(x <= 20 for x in filled)
    # greedy placement never leaves two containers that fit into one
    assert sum(1 for x in levels if 0 < x <= 10) <= max(1, len(levels))


def test_packing(spark):
    docs = [(1, "word " * 30), (2, ""), (3, None), (4, "word " * 5), (4, "word " * 5), (None, "word"), (5, "word " * 64)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = packing.pack_documents(df, capacity=16, shard_items=3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.container_id, []).append(r.n_tokens)
    assert all(sum(v) <= 16 for v in by.values())
    assert {r.container_id: r.container_tokens for r in rows} == {k: sum(v) for k, v in by.items()}
    counts = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in packing.token_counts(df).collect())
    placed = {}
    for r in rows:
        placed[r.doc_id if r.doc_id is not None else -1] = placed.get(r.doc_id if r.doc_id is not None else -1, 0) + r.n_tokens
    total = {}
    for d, n in counts:
        total[d] = total.get(d, 0) + n
    assert placed == total and sum(1 for r in rows if r.doc_id == 4) == 2
    assert packing.pack_documents(df.limit(0)).count() == 0
    # items that never pair: no stage gathers what no stage can fill
    alone = spark.createDataFrame([(k, "word " * 10) for k in range(40)], "doc_id bigint, text string")
    rows = packing.pack_documents(alone, capacity=16, shard_items=3).collect()
    assert len({r.container_id for r in rows}) == len(rows) == 40
    # items that do: few shards still end in nearly full containers
    fitting = spark.createDataFrame([(k, "word " * (k % 3 + 3)) for k in range(120)], "doc_id bigint, text string")
    rows = packing.pack_documents(fitting, capacity=16, shard_items=7).collect()
    assert sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in packing.token_counts(fitting).collect())
    assert len({r.container_id for r in rows}) <= 1.2 * sum(r.n_tokens for r in rows) / 16 + 1


# p8


def brute(docs, items, m):
    grams = {}
    for i, t in items:
        w = leakage.words_of(t or "")
        for k in range(len(w) - m + 1):
            grams.setdefault(tuple(w[k : k + m]), set()).add(i)
    return {(d, i) for d, t in docs for w in [leakage.words_of(t or "")] for k in range(len(w) - m + 1) for i in grams.get(tuple(w[k : k + m]), ())}


def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(12)] + ["Été", "naïve"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(5, 40))) for k in range(12)] + [(50, None), (51, "")]
    items.append((60, items[3][1]))
    docs = [(k, text(60)) for k in range(30)] + [(100, items[0][1].upper().replace(" ", " -- ")), (101, None), (102, ""), (103, text(4) + " " + items[3][1] + " " + text(5))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.find_leaks(df, bench, min_words=4)
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == brute(docs, items, 4)
    assert (103, 3) in got and (103, 60) in got
    assert got[103, 3].match_words >= len(leakage.words_of(items[3][1]))
    assert leakage.remove_leaked(df, found).count() == len(docs) - len({d for d, _ in got})
    assert leakage.find_leaks(df, bench.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), bench).count() == 0


def test_one_word_again_and_again():
    import tracemalloc

    index = leakage.ItemIndex([(1, "word " * 500), (2, "word " * 20 + "other")], 13)
    tracemalloc.start()
    found = leakage.search_shard([(0, "word " * 20_000), (1, "a b c")], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 1, 500, 0, 0), (0, 2, 20, 0, 0)] and peak < 100 << 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=14), min_size=1, max_size=3), st.lists(st.integers(1, 4), min_size=1, max_size=20))
def test_automaton(parts, text):
    import numpy as np

    size, at, place = leakage.Automaton(parts).longest(np.array(text), [(0, len(text))])
    joined = [w for p in parts for w in p]
    inside = lambda n, i: any(p[k : k + n] == text[i : i + n] for p in parts for k in range(len(p) - n + 1))
    best = max((n for i in range(len(text)) for n in range(1, len(text) - i + 1) if inside(n, i)), default=0)
    assert size == best and (not size or text[at : at + size] == joined[place : place + size] and not any(inside(best, i) for i in range(at)))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(text):
    import numpy as np

    assert list(leakage.suffix_array(np.asarray(text))) == sorted(range(len(text)), key=lambda i: text[i:])


# p9


def test_splitting_round_trip():
    tok = ByteBpe(open(DEFAULT_TOKENIZER, "rb").read())
    texts = ["Para one is here. And more, of it!\n\nSecond para follows.\n" * 60, "漢字かな交じり文です。" * 80, "x" * 3000, "word " * 700, "short"]
    for text in texts:
        rows = splitting.split_text(text, tok, 64, 8)
        if tok.count(text) <= 64:
            assert rows == []
            continue
        covered = 0
        for number, start, end, n, overlap, boundary, piece in rows:
            assert text[start:end] == piece and n <= 64 and tok.count(piece) == n and start <= covered
            assert number == 0 or overlap > 0
            covered = end
        assert covered == len(text)


def test_blocks_have_the_same_tokens(monkeypatch):
    with open(DEFAULT_TOKENIZER, "rb") as f:
        tok = ByteBpe(f.read())
    text = "".join(random.Random(2).choices(["word", " ", "\n", "\t", " 12", "é", ". ", "  "], k=3000))
    whole = tok.encode(text)

    class GivesUp:
        def encode_ordinary(self, x, inner=tok._encoding):
            if len(x) > 600:
                raise RuntimeError
            return inner.encode_ordinary(x)

    monkeypatch.setattr("webloom.llm.tokens.BLOCK_CHARS", 300)
    tok._encoding = GivesUp()
    assert tok.encode(text) == whole


def test_weakest_boundaries_go_first():
    cuts = [(10, splitting.PARAGRAPH), (14, splitting.SENTENCE), (20, splitting.SENTENCE)]
    assert [(a, b) for a, b, _ in splitting.merge_segments(cuts, 30, 24, 4)] == [(0, 10), (10, 30)]


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "One sentence here. " * 100), (2, "short"), (3, None), (4, "")], "doc_id bigint, text string")
    rows = splitting.split_documents(df, limit=64, overlap=8).collect()
    assert {r.doc_id for r in rows} == {1} and all(r.n_tokens <= 64 for r in rows)
    assert splitting.split_documents(df.limit(0)).count() == 0
