"""The mention finder against a plain reading of its rules, document by document."""

import itertools
import random
import re
import unicodedata

from noteloom.operators import mentions

COMMON = set(mentions.COMMON_WORDS)


def folded(s):
    return unicodedata.normalize("NFKD", s.lower()).encode("ascii", "ignore").decode()


def in_text(name, text, exact=False):
    end = r"\b" if re.match(r"\w", name[-1]) else r"(?!\w)"
    return re.search(rf"\b{re.escape(name)}{end}", text, 0 if exact else re.IGNORECASE) is not None


def stem(n):
    return "-" in n and n == n.lower()


def bare(n):
    return len(n.split()) == 1 and len(n) >= 4 and not stem(n) and not (n.isupper() and len(n) == 4) and n.lower() not in COMMON and not n.startswith("src:")


def brute(docs, entities, suppressed=()):
    owners = {}
    for key, name, aliases in entities:
        for n in (name, *aliases):
            if bare(n):
                owners.setdefault(folded(n), set()).add(key)
    shared = {n for n, keys in owners.items() if len(keys) > 1}
    out = set()
    for doc, title, tags, text, people in docs:
        title, text = title or "", text or ""
        sure, doubt, proof = set(), set(), set()
        for key, name, aliases in entities:
            names = [name, *aliases]
            doubtful = {n: bare(n) and folded(n) in shared for n in names}
            if any((t or "").lower().strip() == n.lower() for t in tags or [] for n in names):
                sure.add((key, "tagged"))
                proof.add(key)
            if any(n.startswith("src:") and n[4:] in text for n in names):
                sure.add((key, "source_ref"))
                proof.add(key)
            if any(folded(p) == folded(n) for p in people or [] for n in names):
                proof.add(key)
            scopes = [("participant", p.strip()) for p in re.split(r"(?i)\s+(?:/|x|&|vs)\s+", title) if p.strip()] + [("title", title)]
            for kind, scope in scopes:
                whole = kind == "participant"
                hit = [n for n in names if (whole and n.lower() == scope.lower()) or ((len(n) >= 4 if whole else len(n) > 3 and not stem(n)) and in_text(n, scope))]
                firm = [n for n in hit if not doubtful[n]]
                if firm:
                    sure.add((key, kind))
                    if len(firm[0].split()) > 1 or (whole and firm[0].lower() == scope.lower()):
                        proof.add(key)
                elif hit:
                    doubt.add((key, kind))
            for n in names:
                capital, one = n.isupper() and len(n) <= 4, len(n.split()) == 1
                if len(n) < 2 or stem(n) or (one and not capital and re.fullmatch(r"[A-ZÀ-Þ][a-zß-ÿ]{1,2}", n)):
                    continue
                if in_text(n, text, capital or (one and n.lower() in COMMON)):
                    (doubt if one and folded(n) in shared else sure).add((key, "discussed"))
                    if not one:
                        proof.add(key)
        out |= {(k, doc, kind) for k, kind in sure | {x for x in doubt if x[0] in proof} if (doc, k) not in suppressed}
    return out


DOCS = "id long, title string, tags array<string>, text string, attendees array<string>"


def found(spark, docs, entities, suppressed=()):
    hidden = spark.createDataFrame(list(suppressed), "document_id long, entity_id long") if suppressed else None
    rows = mentions.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(entities, "id long, name string, aliases array<string>"), hidden).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_rules(spark):
    entities = [
        (1, "Anna Lind", ["Anna", "anna-lind"]), (2, "Anna Berg", ["Ánna", "Anna B."]), (3, "Data", []), (4, "Ed Stone", ["Ed", "ES"]), (5, "Helix Refactor", ["helix-refactor", "src:C08HJ", "src:ENG-1"]), (6, "Omar", []), (7, "C++ Guild", ["AI"])]
    docs = [
        (1, "weekly", [], "anna said so", None), (2, "weekly", ["Anna Lind"], "anna said so", None), (3, "Anna x Omar", [], None, None), (4, None, None, "anna b. and Anna B.x", []),
        (5, "Omar / Anna", ["x"], "ANNA BERG", None), (6, "1:1 omar", [], "our data, Data too; ed, ES, es", ["Ánna lind"]), (7, "t", [], "see xC08HJy and eng-1", None), (8, "t", [], "anna", ["Anna Lind"]),
        (9, "c++ guild vs ai", [], "AI in c++ guild, ai", None), (10, "Helix  Refactor", [" HELIX-REFACTOR "], "helix refactored by omar_x", None), (11, "", [], "", None), (12, "Ed & ES", [], "Annalind data", None)]
    want = brute(docs, entities)
    assert found(spark, docs, entities) == want
    assert (1, 1, "discussed") not in want and (1, 2, "discussed") in want and (1, 8, "discussed") in want and (5, 7, "source_ref") in want
    hidden = [(5, 2), (2, 1)]
    assert found(spark, docs, entities, hidden) == brute(docs, entities, set(hidden))


def test_random_documents(spark):
    r = random.Random(5)
    words = ["anna", "Anna", "Ánna", "lind", "Berg", "data", "Data", "IT", "it", "Jo", "omar", "x", "&", "-", "L.", "C08HJ", "a_b", "plan"]
    entities = [(i, " ".join(r.choices(words[:12], k=r.choice([1, 2, 2, 3]))), r.sample(["Anna", "L.", "IT", "Jo", "omar", "data", "anna-lind", "src:C08", "Anna L.", "Berg"], 3)) for i in range(25)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 5))), r.sample(words, 1), r.choice([" ", ", ", "."]).join(r.choices(words, k=r.randint(0, 9))), r.choice([None, ["anna"], ["Berg", None]])) for i in range(150)]
    docs = [(a, b, c, d, None if e is None else [x for x in e if x]) for a, b, c, d, e in docs]
    assert found(spark, docs, entities) == brute(docs, entities)


def test_nothing_there(spark):
    assert found(spark, [(1, "t", ["a"], "b", None)], []) == set() and found(spark, [], [(1, "Anna", ["src:abc"])]) == set()


def test_a_long_text_and_many_source_ids(spark):
    ids = ["".join(p) for p in itertools.product("abcdefghijklmnopq", repeat=3)]
    entities = [(i, f"Name {i}", [f"src:{s}9"]) for i, s in enumerate(ids)]
    got = found(spark, [(1, "t", [], "zz " * 50_000 + "xqqq9 name 7", None)], entities)
    assert got == {(len(ids) - 1, 1, "source_ref"), (7, 1, "discussed")}
