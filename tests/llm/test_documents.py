"""Fingerprints, manifests and periodic runs against brute force, SQL and awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textgrade.llm import extraction, imatch, language, merkle, periodic, queries
from textgrade.llm.extraction import main_text, parse
from textgrade.llm.imatch import Lexicon, fingerprint_documents, lexicon_of, likeness
from textgrade.llm.curves import nearest_neighbours
from textgrade.llm.language import identify_language
from textgrade.llm.merkle import merkle_manifest, merkle_sql, without_line_breaks
from textgrade.llm.topk import top_products
from textgrade.llm.periodic import fragments, periodic_runs, planted, stitched, tiles_of, z_function

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, period int, root string"


def sha(text):
    return hashlib.sha256((text if isinstance(text, bytes) else text.encode())).hexdigest()


def awkward_rows():
    """Nulls, empty and very long texts, repeated ids and rows, runs, extra columns named like results."""
    draw = random.Random(9)
    stock = ["ober", "tief", "Haus", "wald", "licht", "berg", "see", "Ähre", "straße", "mond"]
    long = " ".join(draw.choice(stock) + str(draw.randrange(90)) for _ in range(30000))
    texts = [None, "", " \n\t", "wort", "wort", long, "a b\nc " * 9, "x " * 40, " nbsp\n here", "a b", "eins zwei drei vier " * 2100]
    rows = [(i, t, None if i % 3 else "de", f"s{i % 3}" if i % 4 else None, i, "x", 1, "y") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "a b a b", "de", "s1", None, "x", 1, "y"), (None,) * 8, (7, "another\ntext", None, "s1", 2, "x", 1, "y")]
    return rows


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- Merkle manifest


def brute_manifest(rows):
    """``rows`` of (doc_id, source, lang, n_chars, text), ids and leaves as sort keys."""

    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(row):
        return sha("".join(map(framed, row)))

    def tree(nodes):
        """The top and each node's steps of (left, right)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = place - place % 3
                steps[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
            nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
            at = [place // 3 for place in at]
        return nodes[0], steps

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for source in order:
        mine = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        inner[source] = (mine, *tree([leaf(r) for r in mine]))
    root, outer = tree([inner[s][1] for s in order])
    out = []
    for source, above in zip(order, outer, strict=True):
        mine, top, steps = inner[source]
        for row, own in zip(mine, steps, strict=True):
            other = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                other[4] = row[4].replace("\n", "")
            at = leaf(other)
            for left, right in own + above:
                at = sha(left + at + right)
            proof = sha("".join(a + b for a, b in own + above))
            out.append((row[0], leaf(row), top, root, proof, at, at == root))
    return sorted(out, key=repr)


def manifest_of(df):
    rows = merkle_manifest(df, changed=without_line_breaks()).drop("proof").collect()
    return sorted((tuple(r) for r in rows), key=repr)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_manifest_against_brute_force(docs, monkeypatch, digits):
    """Blocks of one, two and six levels: several passes, and one."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    some = docs.where("doc_id < 150").withColumn("source", F.expr("if(doc_id % 7 < 4, 's0', if(doc_id % 7 = 6, null, source))"))
    assert manifest_of(some) == brute_manifest([tuple(r) for r in some.select(FIELDS).collect()])


def test_manifest_of_awkward_rows(awkward, nothing):
    rows = [tuple(r) for r in awkward.select(FIELDS).collect()]
    got = manifest_of(awkward)
    assert got == brute_manifest(rows) and len(got) == len(rows)
    assert manifest_of(nothing) == []
    one = awkward.where("doc_id = 5")
    ((_, leaf, subroot, root, proof, folded, verified),) = manifest_of(one)
    assert leaf == subroot == root == folded and proof == sha("") and verified
    assert merkle_manifest(awkward).where("not verified").isEmpty()


def test_manifest_needs_one_exchange_for_all_levels(docs):
    nodes = docs.selectExpr("source as grp", "doc_id as rank", "5 as levels", "text as digest", "struct(doc_id) as what")
    plan = merkle._roll_up(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_manifest_sql_follows_brute_force(awkward):
    con = duckdb.connect()
    frame = awkward.select(FIELDS).toArrow()
    con.register("documents", frame)
    want = sorted((tuple(r) for r in con.execute(merkle_sql(levels=6)).fetchall()), key=repr)
    assert want == brute_manifest([tuple(r) for r in awkward.select(FIELDS).collect()])


# ---- Periodic runs


def brute_runs(words):
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, length) for (s, length), q in best.items())


def brute_row(doc_id, text, plant):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    top = (None,) * 4
    if runs:
        s, q, length = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1]))
        top = (s, length, q, 1000 * length // q)
    return (doc_id, len(runs), *top, sha(listed), sha(collapsed))


def periodic_rows(df, plant):
    return sorted((tuple(r)[:8] for r in periodic_runs(df, plant=plant).collect()), key=repr)


def test_z_function():
    draw = random.Random(2)
    for _ in range(200):
        s = [draw.randrange(2) for _ in range(draw.randrange(30))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert z_function(s) == want


@pytest.mark.parametrize("tile, low_octaves", [(1 << 13, 11), (16, 2), (32, 1), (64, 4)])
def test_tiles_and_stitching_against_brute_force(spark, monkeypatch, tile, low_octaves):
    monkeypatch.setattr(periodic, "TILE", tile)
    monkeypatch.setattr(periodic, "LOW_OCTAVES", low_octaves)
    draw = random.Random(tile)
    pieces, want = [], []
    for row in range(150):
        n, kinds = draw.randrange(200), draw.choice([1, 2, 3, 60])
        words = [draw.randrange(kinds) for _ in range(n)]
        if n > 10:
            p, a = draw.randrange(1, n // 2), draw.randrange(n // 2)
            for i in range(a + p, min(n, a + p * draw.randrange(2, 12))):
                words[i] = words[i - p]
        ids = np.array(words, dtype=np.int64)
        for first, last, at, end, low, high in tiles_of(n):
            found = fragments(ids[at:end], low - at, high - at, (first, last))
            pieces += [(row, q, s + at, e + at) for q, s, e in found]
        want += [(row, *run) for run in brute_runs(words)]
    table = spark.createDataFrame(pieces, "row long, period int, start long, stop long")
    assert sorted((r.row, r.start, r.period, r.length) for r in stitched(table).collect()) == sorted(want)


def test_runs_of_all_documents_against_brute_force(docs):
    some = docs.where("length(text) < 4000")
    want = sorted((brute_row(r.doc_id, r.text, True) for r in some.collect()), key=repr)
    assert periodic_rows(some, True) == want
    assert sum(w[1] > 0 for w in want) > 5


def test_runs_of_awkward_rows(awkward, nothing, monkeypatch):
    want = sorted((brute_row(r[0], r[1], False) for r in awkward_rows() if (r[1] or "").count(" ") < 9999), key=repr)
    short = awkward.where("length(text) < 50000 or text is null")
    assert periodic_rows(short, False) == want
    assert periodic_rows(nothing, True) == []
    got = {r.doc_id: r for r in periodic_runs(awkward).where("doc_id in (5, 10, 7)").collect() if r.doc_id != 7 or r.n_runs}
    assert (got[10].n_runs, got[10].start, got[10].length, got[10].period) == (1, 0, 8400, 4)
    assert got[10].collapsed == "eins zwei drei vier" and got[7].collapsed == "x"
    assert got[5].n_runs == len(brute_runs_long(awkward_rows()[5][1].split()))


def brute_runs_long(words):
    """As ``brute_runs`` by numpy, for a long text."""
    ids = np.unique(words, return_inverse=True)[1]
    out = set()
    for q in range(1, len(ids) // 4 + 1):
        equal = np.flatnonzero(np.diff(np.concatenate(([0], ids[:-q] == ids[q:], [0])).astype(int)))
        for s, e in zip(equal[::2].tolist(), equal[1::2].tolist(), strict=True):
            if e - s + q >= max(6, 4 * q):
                out.add((s, e - s + q))
    return out


def test_planted_words():
    words = [str(k).encode() for k in range(100)]
    hit = [i for i in range(2000) if planted(words, i) != words]
    assert all(zlib.crc32(str(i).encode()) % 10 == 0 for i in hit) and len(hit) > 100
    assert planted([], hit[0]) == [] and planted(words, None) == words


# ---- I-Match


def brute_terms(text):
    return set(re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())))


def edited_texts(rows):
    """Texts by ascending id with their edited texts and successors; ids are unique."""
    rows = sorted(rows)
    texts = [t or "" for _, t in rows]
    for k, (i, _) in enumerate(rows):
        own, after = texts[k], texts[(k + 1) % len(rows)]
        n = len(own)
        yield i, own, own[: n - n // 4] + after[: n // 4], after


def test_lexicon_is_the_band(docs):
    texts = docs.select("text")
    n = docs.count()
    df = {}
    for r in texts.collect():
        for term in brute_terms(r.text):
            df[term] = df.get(term, 0) + 1
    assert len(lexicon_of(texts)) == sum(max(1, n / 20) >= c >= n / 4000 for c in df.values())
    assert len(lexicon_of(texts, 10, 50)) == sum(n / 10 >= c >= n / 50 for c in df.values())
    few = len(lexicon_of(texts, 10, 50, most=100))
    least = min(c for c in set(df.values()) if sum(n / 10 >= x >= c for x in df.values()) <= 100)
    assert few == sum(n / 10 >= c >= least for c in df.values())


def test_signatures_follow_the_terms_of_subsets():
    """A subset's hash is the same exactly if its terms are."""
    lexicon = Lexicon(lexicon_terms([f"t{k}" for k in range(400)]))
    draw = random.Random(4)
    texts = [" ".join(draw.choices([f"t{k}" for k in range(500)], k=draw.randrange(60))) for _ in range(40)]
    texts += [texts[3] + " " + texts[3], " ".join(sorted(texts[5].upper().split()))]
    sizes, signatures = lexicon.signatures(texts)
    terms = [sorted({t for t in text.lower().split() if int(t[1:]) < 400}) for text in texts]
    at = dict(zip([f"t{k}" for k in range(400)], np.searchsorted(lexicon.terms, lexicon_terms([f"t{k}" for k in range(400)], False)).tolist(), strict=True))
    column = 0
    assert sizes.tolist() == [len(t) for t in terms]
    for dealt in lexicon.subset:
        for subset in range(imatch.SUBSETS):
            within = [tuple(t for t in own if any(d[at[t]] == subset for d in dealt)) for own in terms]
            got = signatures[:, column].tolist()
            assert all((g == 0) == (not w) for g, w in zip(got, within, strict=True))
            assert len(set(zip(got, within, strict=True))) == len(set(within))
            column += 1
    assert (signatures[3] == signatures[40]).all() and (signatures[5] == signatures[41]).all()


def lexicon_terms(names, ordered=True):
    import pyarrow as pa

    from textgrade.llm.hashing import text_bytes, words

    hashes = words(*text_bytes(pa.array([" ".join(names)])))[1]
    return np.sort(hashes) if ordered else hashes


def test_fingerprints_against_brute_force(spark, docs):
    """Neighbours and edited texts over many pieces; likeness near the true share of common terms."""
    rows = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    lexicon = Lexicon(lexicon_of(docs.select("text")))
    near, nexts, gap = [], [], []
    for i, own, edited, after in edited_texts([(r.doc_id, r.text) for r in docs.collect()]):
        got = rows.pop(i)
        assert (got.n_chars, got.edited_sha256) == (len(own), sha(edited))
        sizes, signatures, names = lexicon.fingerprints([own, edited, after])
        assert (got.fingerprint, got.edited_fingerprint) == (names[0], names[1])
        a, b, c = ((sizes[k : k + 1], signatures[k : k + 1], names[k : k + 1]) for k in range(3))
        assert np.isclose(got.near_edited, likeness(*a, *b)[0]) and np.isclose(got.near_next, likeness(*a, *c)[0])
        near.append(got.near_edited)
        nexts.append(got.near_next)
        if own == edited:
            assert got.near_edited == 1.0
    assert not rows
    assert np.mean(near) > 0.5 and np.mean(nexts) < 0.15
    assert np.mean(np.array(near) > np.array(nexts)) > 0.97


def test_fingerprints_of_awkward_rows(awkward, nothing):
    rows = fingerprint_documents(awkward).collect()
    assert len(rows) == len(awkward_rows())
    texts = {}
    for r in rows:
        assert 0.0 <= r.near_edited <= 1.0 and 0.0 <= r.near_next <= 1.0
        texts.setdefault(r.doc_id, []).append(r)
    assert texts[0][0].fingerprint == texts[1][0].fingerprint and texts[3][0].fingerprint == texts[4][0].fingerprint
    assert texts[0][0].near_next == 1.0 and texts[0][0].n_chars == 0 and len(texts[None]) == 2
    assert fingerprint_documents(nothing).collect() == []
    (one,) = fingerprint_documents(awkward.where("doc_id = 8")).collect()
    own = awkward_rows()[8][1]
    assert one.near_next == 1.0 and one.edited_sha256 == sha(own[: len(own) - len(own) // 4] + own[: len(own) // 4])


def test_queries_return_the_contract_columns(spark):
    kinds = {
        queries.op11_imatch_fingerprints: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        queries.op12_merkle_manifest: "doc_id leaf subroot root proof_sha256 folded_root verified",
        queries.op13_periodic_runs: "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    }
    for query, columns in kinds.items():
        assert query(spark, SF).columns == columns.split()


# ---- Main text


PARAGRAPH = "Der Wald liegt hinter dem Dorf und reicht bis an den See, an dem im Sommer die Boote liegen. " * 3


@pytest.mark.parametrize(
    "part, text",
    [
        ('<h2 id="related-work">Verwandtes</h2>', "Verwandtes"),
        ('<h2 id="comment-syntax">Kommentare im Text</h2>', "Kommentare im Text"),
        ('<p id="market-share">Anteil am Markt</p>', "Anteil am Markt"),
        ('<p class="share">Geteilt</p>', "Geteilt"),
        (f'<section id="search"><h2>Suche</h2><p>{PARAGRAPH}</p></section>', "Suche\n" + PARAGRAPH.strip()),
        ('<div class="post-header"><h1>Ein Titel</h1></div>', "Ein Titel"),
        ('<div class="header"><h1>Ein Titel</h1><span>Menü</span></div>', "Ein Titel"),
        ('<header><h1>Ein Titel</h1><span>Menü</span></header>', "Ein Titel"),
        ('<div class="related-work">Was andere fanden.</div>', "Was andere fanden."),
        ('<div id="comments"><h2>Kommentare</h2><p>Schön!</p></div>', None),
        ('<div class="comment-list"><p>Schön!</p></div>', None),
        ('<article class="comment"><p>Schön!</p></article>', None),
        ('<div class="ad">Kauft jetzt.</div>', None),
        ('<div class="cookie-banner top">Wir nutzen Kekse.</div>', None),
        ('<ul class="share-buttons"><li>Teilen</li></ul>', None),
        ('<form class="x"><p>Name</p><input></form>', None),
    ],
)
def test_parts_of_an_article(part, text):
    page = f"<body><nav><a href=x>Menü</a></nav><article><p>{PARAGRAPH}</p>{part}<p>{PARAGRAPH}</p></article><footer>Ende</footer></body>"
    want = [PARAGRAPH.strip(), *([text] if text else []), PARAGRAPH.strip()]
    assert main_text(page) == "\n".join(want)


def density(node, body_share):
    """Link-adjusted characters for each tag, recomputed from the tree."""
    chars = len("".join("".join(flat(node)).split()))
    below = [n for n in elements(node) if n is not node]
    links = [n for n in elements(node) if n.tag == "a" and not any(a.tag == "a" for a in above(n, node))]
    linked = sum(len("".join("".join(flat(n)).split())) for n in links)
    tags, link_tags = max(len(below), 1), max(sum(n.tag == "a" for n in below), 1)
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - linked, 1) * linked + body_share * chars + math.e) + 1
    return chars / tags * math.log(max(chars / max(linked, 1) * tags / link_tags, 1)) / math.log(base)


def flat(node):
    return [x for p in node.parts for x in ([p] if isinstance(p, str) else flat(p))]


def elements(node):
    return [node, *[n for p in node.parts if not isinstance(p, str) for n in elements(p)]]


def above(node, top):
    out = []
    while node is not top:
        node = node.parent
        out.append(node)
    return out


def test_densities_and_threshold_by_themselves():
    """A page of divs: the kept blocks are those that reach the least density between the densest element and the body."""
    draw = random.Random(8)
    for _ in range(30):
        blocks = []
        for k in range(draw.randrange(2, 7)):
            words = [f"w{k}{i}" for i in range(draw.randrange(1, 60))]
            linked = draw.randrange(len(words) + 1)
            links = "".join(f"<a href=x>{w}</a> " for w in words[:linked])
            blocks.append(f"<div><p>{links}{' '.join(words[linked:])}</p></div>")
        page = f"<body><div>{''.join(blocks)}</div><div>{draw.choice(blocks)}</div></body>"
        root = parse(page)
        body = next(n for n in elements(root) if n.tag == "body")
        whole = "".join("".join(flat(body)).split())
        share = sum(len("".join(flat(n))) for n in elements(body) if n.tag == "a") / max(len(whole), 1)
        own = {id(n): density(n, share) for n in elements(body)}
        inner = {id(n): [own[id(p)] for p in n.parts if not isinstance(p, str)] for n in elements(body)}
        total = {n: sum(c) if c else own[n] for n, c in inner.items()}
        extraction._measure(root, body)
        for n in elements(body):
            assert math.isclose(n.density, own[id(n)], abs_tol=1e-9) and math.isclose(n.total, total[id(n)], abs_tol=1e-9)
        centre = max(elements(body), key=lambda n: total[id(n)])
        least = min(own[id(n)] for n in [centre, *above(centre, body)])
        way = {id(n) for n in [centre, *above(centre, body)]}

        def taken(node):
            if node is centre or (id(node) not in way and own[id(node)] >= least and "".join(flat(node)).strip()):
                return [" ".join("".join(flat(n)).split()) for n in elements(node) if n.tag == "p"]
            return [x for p in node.parts for x in taken(p)] if id(node) in way else []

        assert main_text(page) == "\n".join(x for x in taken(body) if x)


# ---- Language identification


def posteriors(rows):
    """All of the posterior again, from the table: models, background, host priors, declarations and suffixes."""

    def grams(text):
        return [b for part in language.trigrams(text or "") for b in part.tolist()]

    names = sorted({r[2] for r in rows if r[2] is not None and r[1] is not None})
    model = {n: collections.Counter(g for r in rows if r[2] == n for g in grams(r[1])) for n in names}
    size = language.BUCKETS
    total = {n: sum(c.values()) + 0.5 * size for n, c in model.items()}

    def text_logs(text):
        return {n: sum(math.log((model[n][g] + 0.5) / total[n]) for g in grams(text)) / 3 for n in names}

    def weigh(logs):
        most = max(logs.values())
        mass = {n: math.exp(v - most) for n, v in logs.items()}
        return {n: v / sum(mass.values()) for n, v in mass.items()}

    def host(url):
        name = re.sub(r"^https?://([^/]*).*", r"\1", url).lower()
        labels = name.split(".")
        return (name, ".".join(labels[-2:]), labels[-1]) if len(labels) > 1 else (name, name, None)

    seen, own = [], []
    for _, text, declared, url in rows:
        logs = text_logs(text)
        p, n = weigh(logs), len(grams(text))
        flat = -n * math.log(size) / 3 + math.log(0.01 / 0.99 * len(names))
        foreign = weigh({**logs, None: flat})[None]
        best = max(names, key=lambda x: p[x])
        sure = best if n and p[best] >= 0.9 and foreign < 0.5 else None
        own.append((logs, n, foreign))
        seen.append((*(host(url) if url else (None,) * 3), declared, sure))
    count = lambda place, value: collections.Counter(s[4] for s in seen if s[place] == value and s[4] is not None)
    everywhere = collections.Counter(s[4] for s in seen if s[0] is not None and s[4] is not None)
    base = {n: (everywhere[n] + 1) / (sum(everywhere.values()) + len(names)) for n in names}
    out = []
    for (logs, n, foreign), s in zip(own, seen, strict=True):
        logs = dict(logs)
        if s[0] is not None:
            here, around = count(0, s[0]), count(1, s[1])
            for k in names:
                wide = (around[k] + 20 * base[k]) / (sum(around.values()) + 20)
                logs[k] += math.log((here[k] + 20 * wide) / (sum(here.values()) + 20))
        for place in (3, 2):
            if s[place] is not None:
                values = len({x[place] for x in seen if x[place] is not None})
                for k in names:
                    in_k = sum(1 for x in seen if x[place] is not None and x[4] == k)
                    logs[k] += math.log((count(place, s[place])[k] + 1) / (in_k + values))
        p = weigh(logs)
        best = max(names, key=lambda x: p[x])
        out.append((best, p[best] * (1 - foreign if n else 1.0)))
    return out


STOCK = {
    "en": "the wood and night with some light over every hill where people walk slowly home".split(),
    "nl": "het bos en de nacht met wat licht over elke heuvel waar mensen langzaam naar huis lopen".split(),
    "sv": "skogen och natten med lite ljus över varje kulle där folk går långsamt hem".split(),
}
TABLE = "doc_id long, text string, lang string, source string"


def speak(draw, name, n):
    return " ".join(draw.choice(STOCK[name]) for _ in range(n))


def test_posterior_recomputed(spark):
    draw = random.Random(6)
    rows = [(i, speak(draw, n, draw.randrange(1, 12)), n if i % 3 else None, f"http://w{i % 4}.a-{n}.{n}/x" if i % 5 else None) for i, n in enumerate(draw.choices(list(STOCK), k=80))]
    rows += [(100, "xq", None, "http://new.a-sv.sv/"), (101, "xq zz", "nl", None), (102, "", "en", "w1.a-en.en"), (103, None, None, None), (104, "the och", "sv", "plain")]
    found = {r.doc_id: r for r in identify_language(spark.createDataFrame(rows, TABLE)).collect()}
    for row, (name, p) in zip(rows, posteriors(rows), strict=True):
        got = found[row[0]]
        assert (got.language == name or abs(p - 1 / 3) < 0.2) and math.isclose(got.confidence, p, rel_tol=1e-3, abs_tol=1e-6)


@pytest.mark.parametrize("others", [1000, 3000])
def test_a_rare_language_stays_at_every_size(spark, others):
    draw = random.Random(7)
    rows = [(i, speak(draw, "en", 40), "en", "s0") for i in range(others)] + [(10000 + i, speak(draw, "nl", 40), "NL-be", "s0") for i in range(12)]
    found = identify_language(spark.createDataFrame(rows, TABLE))
    assert [(r.language, r.kept) for r in found.where("doc_id >= 10000").collect()] == [("nl", True)] * 12


def test_many_declared_values(spark):
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {k: ["".join(draw.choices(letters, k=draw.randrange(3, 9))) for _ in range(12)] for k in range(500)}
    rows = [(2 * k + j, " ".join(draw.choices(words[k], k=40)), f"l{k}", "h") for k in words for j in range(2)]
    table = spark.createDataFrame(rows, TABLE)
    found = identify_language(table).collect()
    assert len(found) == 1000 and all(r.language == r.declared and r.kept for r in found)
    few = identify_language(table, languages=3).collect()
    assert len({r.language for r in few}) <= 3 and len(few) == 1000


def test_evidence_of_pages(spark):
    """Addresses and markup act: a page without letters gets its host's language."""
    found = queries.pages_language_id(spark, SF).toPandas()
    assert len(found) == spark.read.parquet(f"{SF}/pages.parquet").count() and found["declared"].notna().all()
    assert (found["language"] == found["declared"]).mean() > 0.95 and found["kept"].all()


# ---- Very large values


def test_products_beyond_a_long(spark):
    rows = [(0, [1e20, 1.0]), (1, [1e20, 0.0]), (2, [3e9, 0.5]), (3, [0.5, 0.25]), (4, [-1e20, 7.0]), (50, [2.0, -3e9]), (100, [3e9, 3e9])]
    whole = {i: [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v] for i, v in rows}
    found = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in (0, 50, 100):
        scores = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in sorted(scores)[:5]]


def test_neighbours_of_far_points(spark):
    """One far query, candidate or pair leaves the others' answers as they are."""
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000, [1e200] + [0.0] * 7), (1001, [1e200] + [1.0] * 7), (1002, [1e308] * 8), (1100, [-1e308] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest_neighbours(table).collect()
    plain = np.array([v for _, v in rows[:400]])
    for q in (0, 100, 200, 300):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        true = np.sort(np.sqrt(((plain - plain[q]) ** 2).sum(axis=1)))[1:11]
        assert [r.rank for r in mine] == list(range(1, 11)) and sum(np.isclose(r.score, true).any() for r in mine) >= 9
    far = sorted((r for r in found if r.query_id == 1000), key=lambda r: r.rank)
    assert far[0].vec_id == 1001 and far[0].score == math.sqrt(7) and all(math.isclose(r.score, 1e200) for r in far[1:9])
    assert len([r for r in found if r.query_id == 1100]) == 10
