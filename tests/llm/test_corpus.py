import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tallystone.llm import fingerprints, langid, lm, mixing, neardup, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lower(s):
    return s.encode().lower().decode()


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# mixing


def spark_hash_long(seed_int, value):
    h = xxhash.xxh64_intdigest(seed_int.to_bytes(4, "little"), 42)
    return h if value is None else xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), h)


def mix_by_hand(rows, passes=3, block=None, weights=(5, 2, 1), seed=7):
    sizes = Counter()
    for _, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if level * w[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: float(3 * sizes[s]) if s in capped else level * w[s] for s in order}
    block = block or max(16, -(-total // (1 << 20)))
    lo, at = [], 0.0
    for s in order:
        lo.append((at / total, (at + target[s]) / total, s))
        at += target[s]
    slots = Counter()
    for i in range(-(-total // block)):
        u = (i * mixing.PHI % (1 << 64)) / (1 << 64)
        slots.update(s for a, b, s in lo if a <= u < b and target[s] > 0)
    out = []
    for s in order:
        n = len(rows)
        own = sorted([(signed(spark_hash_long(seed, d)), d, len(WORD.findall(t or "")), signed(xxhash.xxh64_intdigest((t or "").encode(), 42))) for d, src, t in rows if src == s], key=lambda r: ((r[0] % (1 << 64) >> 32) % max(64, n // 50_000), r[0], r[1], r[2], r[3]))
        used, place = min(slots[s] * block, passes * sizes[s]), 0
        for _, d, size, _ in own:
            got = sum(max(0, min(used, k * sizes[s] + place + size) - (k * sizes[s] + place)) for k in range(passes))
            out.append((d, s, size, sizes[s], round(target[s], 6), got))
            place += size
    return out


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "b", "b", "b", "Z", "é", None, "😀"]), " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, "a", None), (901, "tiny", "one two"), (902, "empty", ""), (903, "b", "x y"), (903, "b", "x y"), (904, "b", " ".join("v" for _ in range(5000)))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).repartition(5)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in (r[0], str(r[1]), *r[2:]))
    want = sorted(mix_by_hand(rows), key=key)
    got = sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mixed(df).collect()), key=key)
    assert got == want
    assert abs(sum(r[5] for r in got) - sum(r[2] for r in got)) < 400
    for r in got:
        assert r[5] <= 3 * r[2]
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns
    times = Counter(r.doc_id for r in copies.collect())
    assert all(times[r[0]] == math.floor(r[5] / max(1, r[2]) + 0.5) for r in got if r[0] != 903)
    assert mixing.mixed(df.limit(0)).count() == 0


# near-duplicates


def print_by_hand(text, words=3):
    t = WORD.findall(lower(text or ""))
    if not t:
        return 0
    grams = [" ".join(t[i : i + words]) for i in range(max(1, len(t) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_by_hand(prints, radius=2):
    nodes = sorted(set(prints))
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in combinations(nodes, 2):
        if (a ^ b).bit_count() <= radius:
            up[top(b)] = top(a)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("crowd", [48, 3])
def test_near_duplicates(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    rng = random.Random(4)
    base = [" ".join(rng.choice("the of and to in is for on with at by".split()) + str(rng.randrange(30)) for _ in range(150)) for _ in range(15)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
        rows.append((100 + i, " ".join(words).replace(" ", rng.choice([" ", "\n\t"]))))
    rows += [(500, None), (501, ""), (502, " \t "), (None, base[0]), (503, "One two"), (504, "one  TWO"), (5, base[5]), (505, "É"), (506, "é"), (507, "nbsp here x y z")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int").repartition(3)
    prints = {r: print_by_hand(r[1]) for r in rows}
    roots = roots_by_hand(prints.values())
    least = {}
    for (i, t), p in prints.items():
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    got = neardup.near_duplicates(df).collect()
    want = Counter((i, f"{print_by_hand(t):016x}", least.get(roots[prints[(i, t)]])) for i, t in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len(set(w[2] for w in want)) < len(rows) - 20
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_links_of_clusters_against_brute_force(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in prints[:6]:
        for _ in range(150):
            q = p
            for _ in range(rng.randint(1, 4)):
                q ^= 1 << rng.randrange(10)
            prints.append(q)
    roots = roots_by_hand(prints)
    df = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    got = {r.node: r.root for r in neardup.components(neardup.links(df)).collect()}
    same = lambda names: {frozenset(n for n in names if names[n] == r) for r in set(names.values())}
    assert same({signed(n): r for n, r in roots.items()}) == same({signed(n): got.get(signed(n), signed(n)) for n in roots})


def test_kept_documents(spark):
    text = " ".join(f"w{i % 37}" for i in range(300))
    rows = [(4, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (7, "alone here", "d"), (None, "nobody", "e"), (9, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = neardup.kept_documents(df).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter([(2, "b"), (7, "d"), (None, "e"), (9, "f")])


# personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def base_by_hand(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(text or "") if passes(kind, m[0]))


def digest(spans):
    return hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans).encode()).hexdigest()


def test_base_spans(spark):
    rng = random.Random(6)
    texts = [None, "", "é🙂 a@b.co", "x@y.z%w@v.u", "1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255", "4111 1111 1111 1111", "41111111111111111111111", "+1 (743) 555-3824 +44 20 7946 0958.", "9" * 30000, "a" * 30000 + "@b.c", "1 " * 20000, "-" * 3000 + "@" + "a-" * 3000, "+1" + " " * 5000, "4111-1111 1111-1111, 4111  1111", "0" * 400 + "1.1.1.1"]
    for alphabet in ("0123456789 -+.@ab()", "ab.@%-", "01 -", "12.5", "+1 (.)-"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(120)]
    texts += [" ".join("".join(rng.choice("0123456789") for _ in range(rng.randint(11, 20))) for _ in range(20)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 2), (None, texts[4], 3)], "doc_id long, text string, text_key int").repartition(4)
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = base_by_hand(texts[4 if r.doc_id is None else r.doc_id])
        kinds = Counter(s[3] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in BASE), texts[r.doc_id or 4]
        assert r.base_sha256 == digest(want), texts[r.doc_id or 4]
        assert set(f"{kind}:{a}:{b}" for a, _, b, kind in want) <= set(filter(None, r.spans.split(",")))
    assert pii.personal_data(df.limit(0)).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"some words then mobile number: +1 (212) 555-{1000 + i} and more") for i in range(20)]
    rows += [(100, "her mobile number: 0212 555 7788 is new"), (101, "the total was 0212 555 7799 units"), (102, "room 0212 555 7788 again")]
    rows += [(i, f"the total was plain words {i}") for i in range(200, 230)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[100] == "phone:19:32" and got[101] == ""
    masked = {r.doc_id: r.text for r in pii.masked_documents(df.withColumn("n_chars", F.length("text"))).collect()}
    assert masked[100] == "her mobile number: <phone> is new" and masked[101] == rows[21][1]
    assert masked[3] == "some words then mobile number: <phone> and more"


def extraction_by_hand(rows):
    """rows: (id, text); id -> all spans, as text, by plain loops over the graph of patterns and instances."""
    base, loose, times = {}, {}, Counter()
    context = lambda gap: (m[1].lower(), m[2].lower()) if (m := regex.search(r"(\p{L}+)[^\p{L}]+(\p{L}+)[^\p{L}\p{N}]*$", gap)) else None
    touches = lambda a, others: any(a[0] < b[1] and a[1] > b[0] for b in others)

    def matches(pattern, text):
        at = 0
        for m in regex.finditer(pattern, text):
            yield m.start(), m.end(), context(text[at : m.start()]), m[0]
            at = m.end()

    for i, text in rows:
        words = regex.findall(r"\p{L}+", text.lower())
        times.update(zip(words, words[1:]))
        base[i] = [(a, b, c, m.lower(), k) for k, kind in enumerate(pii.KINDS) for a, b, c, m in matches(pii.PATTERNS[kind], text) if passes(kind, m)]
        masked = [(a, b, c, m.lower(), 0) for a, b, c, m in matches(pii.MASKED, text) if not touches((a, b), base[i])]
        chunks = []
        for a, _, c, m in matches(pii.CHUNKS, text):
            own = regex.sub(pii.TRAIL, "", m)
            if own and not touches((a, a + len(own)), [*base[i], *masked]):
                chunks.append((a, a + len(own), c, own.lower() if regex.search(r"\p{L}", own) else re.sub("[^0-9@]", "", own), -1))
        loose[i] = masked + chunks
    seeds = Counter((c, inst, k) for v in base.values() for _, _, c, inst, k in v if c)
    edges = Counter((c, inst) for v in loose.values() for _, _, c, inst, _ in v if c)
    held = {}
    for _ in range(pii.ROUNDS):
        score, support = Counter(), {}
        for (c, inst, k), n in seeds.items():
            score[c, k] += n
            support.setdefault((c, k), set()).add(inst)
        for (c, inst), n in edges.items():
            if inst in held:
                k, b = held[inst]
                score[c, k] += n * b
                if b >= pii.BELIEF:
                    support.setdefault((c, k), set()).add(inst)
        known = {ck: min(0.99, s / times[ck[0]]) for ck, s in score.items() if len(support.get(ck, ())) >= pii.SUPPORT and any(c == ck[0] for c, _ in edges)}
        doubt = {}
        for c, inst in edges:
            for k in range(4):
                if known.get((c, k), 0) >= pii.FAINT:
                    doubt[inst, k] = doubt.get((inst, k), 1) * (1 - known[c, k])
        held = {}
        for (inst, k), d in sorted(doubt.items(), key=lambda x: x[0][1]):
            if inst not in held or 1 - d > held[inst][1] + 1e-12:
                held[inst] = (k, 1 - d)
    sure = {}
    for (c, k), x in sorted(known.items(), key=lambda y: y[0][1]):
        if x >= pii.SURE and (c not in sure or x > sure[c][1]):
            sure[c] = (k, x)
    out = {}
    for i, _ in rows:
        spans = [(a, k, b) for a, b, _, _, k in base[i]]
        for a, b, c, inst, hint in loose[i]:
            kind = sure[c][0] if c in sure else held[inst][0] if inst in held and held[inst][1] >= pii.BELIEF else None
            if kind is not None and hint in (-1, kind):
                spans.append((a, kind, b))
        out[i] = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return out


def test_graph_scores_against_brute_force(spark):
    rng = random.Random(13)
    two = [f"{a} {b}" for a in ("call", "mail", "ring", "host", "dial", "Pay") for b in ("me", "now", "at", "Über")]
    hard = [lambda: f"+1 212 555 {rng.randrange(1000, 1030)}", lambda: f"u{rng.randrange(20)}@ex{rng.randrange(3)}.org", lambda: f"10.0.{rng.randrange(9)}.{rng.randrange(300)}"]
    soft = [lambda: f"0212 555 {rng.randrange(20)}", lambda: f"AB-{rng.randrange(30)}.", lambda: f"user{rng.randrange(9)}@host", lambda: f"bob{rng.randrange(9)} (at) ex (dot) org", lambda: f"({rng.randrange(100, 120)}) 77;", lambda: "4111 1111 1111 1112"]
    rows = []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(0, 6)):
            c = rng.choice(two)
            kind = hard[two.index(c) % 3] if rng.random() < 0.5 else rng.choice(soft)
            parts.append(f"{rng.choice(['so', 'then', 'x1 we', ''])} {c}{rng.choice([': ', ' ', ', '])}{kind() if rng.random() < 0.8 else 'plain word'}")
        rows.append((i, " and ".join(parts)))
    want = extraction_by_hand(rows)
    got = {r.doc_id: (r.spans, r.n_found) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i: g[0] for i, g in got.items()} == want
    assert sum(g[1] for g in got.values()) > 50


def test_a_second_round_finds_what_no_seed_leads_to(spark):
    """Seeds lead to "mobile number"; what it finds leads to "ring office", and that to a number which stands nowhere else."""
    rows = [(i, f"his mobile number: +1 (212) 555-{1000 + i} today") for i in range(20)]
    rows += [(100 + i, f"her mobile number: 0212 555 77{i}0 today") for i in range(4)]
    rows += [(200 + i, f"please ring office: 0212 555 77{i}0 now") for i in range(4)]
    rows += [(300, "please ring office: 0999 11 22 now"), (301, "please write letters: 0999 11 33 now")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[300] == "phone:20:30" and got[301] == ""
    assert got == extraction_by_hand(rows)
    far = [(400, "x" * 200 + "-" + "y" * 200 + " " * 300 + "ring" + " " * 300 + "office" + "." * 300 + " 0999 44 55")]
    assert {r.doc_id: r.n_found for r in pii.personal_data(spark.createDataFrame(rows + far, "doc_id long, text string")).collect()}[400] == 1


# fingerprints


def term_print(text):
    t = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    h = lambda s, seed=42: xxhash.xxh64_intdigest(s.encode(), seed)
    hashes = [h(b, h(a)) for a, b in zip(t, t[1:])] if len(t) > 1 else [h(w) for w in t]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 60))) for _ in range(90)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(300, None), (301, ""), (320, texts[0]), (340, "x" * 40_000), (None, "lost one here"), (60, texts[20])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, fp string").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    prints = [term_print(r[1] or "") for r in rows]
    want = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[: len(t) - cut] + n[:cut]
        p, q = term_print(t), term_print(e)
        near = sum((x ^ p).bit_count() <= fingerprints.RADIUS for x in prints) if i is not None and i % 20 == 0 else None
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{p:016x}", f"{q:016x}", like(p, q), like(p, term_print(n)), near))
    got = Counter(tuple(r) for r in fingerprints.compared(df).collect())
    assert got == Counter(want)
    assert fingerprints.compared(df.limit(0)).count() == 0
    assert len(fingerprints.compared(df.where('doc_id = 9')).collect()) == 1


def test_block_tables_find_all(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in list(prints):
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = Counter((r.q, r.fp, r.bits) for r in fingerprints.within(df.limit(300), df).collect())
    asked = {r.fp for r in df.limit(300).collect()}
    want = Counter((a, signed(b), d) for a in asked for b in set(prints) if (d := ((a % (1 << 64)) ^ b).bit_count()) <= fingerprints.RADIUS)
    assert got == want


# languages


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, "0x9f 77 ## 1234 %% 88", None, "new", 0), (None, "the of and in that", "en-US", "s", 0)], docs.schema)
    both = docs.union(extra)
    got = langid.document_languages(both, ["doc_id"]).collect()
    assert len(got) == both.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    right = [r.lang == truth[r.doc_id] for r in got if r.doc_id in truth]
    assert sum(right) / len(right) > 0.98
    assert sum(r.accepted for r in got if r.doc_id in truth) / len(right) > 0.98
    assert langid.document_languages(both.limit(0), ["doc_id"]).count() == 0


def test_declared_and_host_decide_without_text(spark):
    model = langid.TextModel.fit([("aa", "alpha beta gamma " * 50), ("zz", "kilo lima mike " * 50)])
    rows = [(i, "alpha gamma", "aa", "h1", "xx") for i in range(40)] + [(100 + i, "kilo mike", "zz", "h2", "yy") for i in range(40)]
    rows += [(200, None, "zz", None, None), (201, None, None, "h1", "xx"), (202, None, None, "new", "yy"), (203, "alpha", None, "h2", "yy")]
    df = spark.createDataFrame(rows, "id long, text string, d string, h string, s string")
    got = {r.id: r.lang for r in langid.identify(df, model, ["id"], "text", declared=F.col("d"), suffix=F.col("s"), host=F.col("h")).collect()}
    assert (got[200], got[201], got[202]) == ("zz", "aa", "zz")


def fused_by_hand(model, rows, trust=0.8, host_strength=5.0, suffix_strength=20.0):
    """rows: (id, text, declared, host, suffix); id -> (lang, probability)."""
    classes = [*model.languages, "und"]
    size = len(classes)

    def normal(logs):
        raised = np.exp(np.array(logs) - max(logs))
        return raised / raised.sum()

    beliefs = []
    for _, text, *_ in rows:
        means, n = model.score(text)
        beliefs.append(normal(np.array(means) * min(n, langid.WEIGHT)))
    codes = [None if d is None else d.split("-")[0].lower() for _, _, d, _, _ in rows]
    overall = (np.sum(beliefs, axis=0) + 1) / (len(rows) + size)
    overall[-1] = langid.EVEN
    overall /= overall.sum()
    by_code = {c: sum((b for b, d in zip(beliefs, codes) if d == c), np.zeros(size)) for c in classes[:-1]}
    seen = sum(by_code.values())
    out = {}
    for k, (i, _, _, host, suffix) in enumerate(rows):
        other = lambda at, value: sum((b for j, b in enumerate(beliefs) if j != k and rows[j][at] == value), np.zeros(size))  # noqa: B023, E731
        parent = overall
        if suffix is not None:
            mix = other(4, suffix)
            parent = (mix + suffix_strength * overall) / (mix.sum() + suffix_strength)
        prior = parent
        if host is not None:
            mix = other(3, host)
            prior = (mix + host_strength * parent) / (mix.sum() + host_strength)
        said = np.zeros(size)
        if codes[k] in by_code:
            said = np.array([np.log((by_code[codes[k]][c] + 10 * (trust if classes[c] == codes[k] else (1 - trust) / max(1, size - 2)) + 0.01) / (seen[c] + 10 + 0.01 * size)) for c in range(size)])
        p = normal(np.log(beliefs[k] + 1e-12) + said + np.log(prior + 1e-9))
        out[i] = (classes[int(np.argmax(p))], float(p.max()))
    return out


def test_fusion_against_brute_force(spark):
    rng = random.Random(5)
    words = {"aa": "alpha beta gamma delta", "bb": "kilo lima mike november", "cc": "papa quebec romeo sierra"}
    model = langid.TextModel.fit([(c, w * 40) for c, w in words.items()])
    rows = []
    for i in range(300):
        lang = rng.choice("aabb aabb cc".split()) if i % 2 else "aa"
        lang = lang[:2]
        text = rng.choice([None, "", " ".join(rng.choice(words[lang].split()) for _ in range(rng.randint(1, 9))), "0x9f 12", " ".join(rng.choice(words[x].split()) for x in words)])
        rows.append((i, text, rng.choice([None, lang, lang + "-XX", "zz", "AA"]), rng.choice([None, "h" + lang, "shared"]), rng.choice([None, lang, "com"])))
    want = fused_by_hand(model, rows)
    df = spark.createDataFrame(rows, "id long, text string, d string, h string, s string").repartition(4)
    got = langid.identify(df, model, ["id"], "text", declared=F.col("d"), suffix=F.col("s"), host=F.col("h")).collect()
    assert len(got) == 300
    for r in got:
        assert (r.lang, r.probability) == (want[r.id][0], pytest.approx(want[r.id][1], abs=2e-5)), rows[r.id]


def test_languages_of_hidden_labels(spark):
    """Rows outside the fitting sample get their language with the declared code hidden, from the text alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fitted(docs)
    got = langid.identify(docs, model, ["doc_id", F.col("lang").alias("truth")]).where("truth is not null").collect()
    assert sum(r.lang == r.truth for r in got) / len(got) > 0.98


def test_every_label_is_a_class(spark):
    """Forty languages, the rarest with five rows, each get their own class."""
    rng = random.Random(3)
    codes = [a + b for a in "bdfgk" for b in "aeiouyzx"]
    words = {c: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for c in codes}
    rows = [(100 * k + j, " ".join(rng.choice(words[c]) for _ in range(30)), c, "s") for k, c in enumerate(codes) for j in range(5 + k)]
    rows += [(9000, "odd", "not a code", "s"), (9001, "few", "qq", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert langid.fitted(df).languages == sorted(codes)
    got = langid.document_languages(df, ["doc_id"]).collect()
    truth = {r[0]: r[2] for r in rows}
    assert sum(r.lang == truth[r.doc_id] for r in got if r.doc_id < 9000) >= 0.99 * len(rows)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = langid.page_languages(pages, spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == pages.count() and {r.lang for r in got} <= {"en", "de", "fr", "es", "und"}


# language model


@pytest.fixture(scope="module")
def lm_rows():
    rng = random.Random(12)
    after = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(900):
        w, out = rng.randrange(40), []
        for _ in range(40):
            out.append(f"w{w}" if rng.random() > 0.05 else f"rare{rng.randrange(3000)}")
            w = rng.choice(after[w])
        rows.append((i, " ".join(out)))
    return rows + [(2000, None), (2001, ""), (2002, "  Two   SPACES\t here "), (2003, rows[3][1]), (2003, rows[3][1]), (None, "no id É"), (2004, "unseen1 unseen2")]


def test_lm_scores(spark, lm_rows):
    df = spark.createDataFrame([(*r, 1.0) for r in lm_rows], "doc_id long, text string, score double").repartition(3)
    tokens = lambda t: [*WORD.findall(lower(t or "")), ""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in lm_rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = lm.scores(df).collect()
    assert len(got) == len(lm_rows)
    want = Counter()
    for i, t in lm_rows:
        own = tokens(t)
        want[(i, held(i), len(own), sum(count[w] > 0 for w in own), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    better = [r.score - r.base_score for r in got if r.held_out and r.n_tokens > 20]
    assert sum(better) > 0
    assert lm.scores(df.limit(0)).count() == 0


def test_every_place_is_visited_once(spark, lm_rows, tmp_path):
    """Round by round, the places that training takes are all places of the training texts, with their contexts."""
    import pyarrow as pa

    texts = [t for i, t in lm_rows if i is not None and i < 300]
    head = [(f"w{i}", 900) for i in range(40)]
    classes = lm.Classes(head, {}, 900)
    want, got = Counter(), Counter()
    for t in texts:
        ids = [classes.start] * 2 + classes.classify(lower(t).encode().split()).tolist() + [classes.end]
        want.update(zip(ids[1:], ids, ids[2:]))
    for _, words, tokens, sizes in lm.tokenised(pa.array(texts)):
        w, h1, h2, _, starts = classes.sequence(words, tokens, sizes)
        turns = (np.arange(len(w)) - np.repeat(starts, sizes + 1)) % lm.ROUNDS
        for turn in range(lm.ROUNDS):
            got.update(zip(h1[turns == turn].tolist(), h2[turns == turn].tolist(), w[turns == turn].tolist()))
    assert got == want


def sequences(classes, texts):
    import pyarrow as pa

    for _, words, tokens, sizes in lm.tokenised(pa.array(texts, pa.string())):
        yield classes.sequence(words, tokens, sizes)[:3]


def test_scorer_is_normalised_and_learns(lm_rows):
    head = [(f"w{i}", 900) for i in range(40)]
    classes = lm.Classes(head, {}, 900)
    trainer = lm.Trainer(classes, lm.Parameters(classes), 1)
    for _ in range(30):
        for w, h1, h2 in sequences(classes, [t for _, t in lm_rows[:900]]):
            trainer.add(h1, h2, w)
    trainer.flush()
    rows = dict(enumerate(trainer.p.rows))
    s = lm.Scorer(classes, rows)
    for h1, h2 in ((0, 1), (classes.start, classes.start), (5, classes.size - 1)):
        p = np.exp(s.one[h1].astype(np.float64) + s.two[h2] - s.log_z[h1, h2])
        assert abs(p.sum() - 1) < 1e-3
    even = lm.Scorer(classes, {})
    total = lambda of: sum(of.score(w, h1, h2).sum() for w, h1, h2 in sequences(classes, [t for _, t in lm_rows[:50]]))
    assert total(s) > total(even) + 1000


def test_scores_against_plain_loops(spark, lm_rows, monkeypatch):
    """Every score from the trained rows: softmax over all classes, then the word's share of its class."""
    monkeypatch.setattr(lm, "LOCAL", 30)  # most counts come by the join
    monkeypatch.setattr(lm, "HEAD", 20)
    kept = {}
    model_of = lm.model_of
    monkeypatch.setattr(lm, "model_of", lambda *a: kept.setdefault("model", model_of(*a)))
    df = spark.createDataFrame(lm_rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in lm.scores(df).collect()}
    classes, rows, *_ = kept["model"]
    p = lm.Parameters(classes, rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    count = Counter(w for i, t in lm_rows if not held(i) for w in [*WORD.findall(lower(t or "")), ""])
    groups, kinds = Counter(), Counter()
    for w, n in count.items():
        c = classes.end if w == "" else classes.ids[w.encode()]
        groups[c] += n
        kinds[c] += 1
    for i, t in lm_rows[:40] + lm_rows[-7:]:
        total, before = 0.0, [classes.start, classes.start]
        for w in [*WORD.findall(lower(t or "")), ""]:
            c = classes.end if w == "" else classes.ids[w.encode()]
            logits = ((p.r[before[-1]] @ p.c1 + p.r[before[-2]] @ p.c2) @ p.q.T + p.b).astype(np.float64)
            total += (logits[c] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / np.log(10)
            if c >= classes.first_tail:
                total += np.log10((count[w] + 0.1) / (groups[c] + 0.1 * (kinds[c] + 1)))
            before.append(c)
        assert got[i] == pytest.approx(total, abs=1e-3 * len(before)), i


def test_similar_documents_share_a_class(spark):
    rng = random.Random(21)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows, near, far = [], [], []
    for i in range(60):
        text = fresh(200)
        words = text.split()
        a, b = words[:], words[:]
        for j in rng.sample(range(200), 2):
            a[j] = "edited"
        for j in rng.sample(range(200), 40):
            b[j] = "other" + str(j)
        rows += [(3 * i, text), (3 * i + 1, " ".join(a)), (3 * i + 2, " ".join(b))]
        near.append((3 * i, 3 * i + 1))
        far.append((3 * i, 3 * i + 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.doc_id: r.root for r in neardup.similar_classes(df).collect()}
    assert sum(root[a] == root[b] for a, b in near) >= 58
    assert all(root[a] != root[b] for a, b in far)
    stay = {r.doc_id for r in neardup.kept_documents(df).collect()}
    assert len(stay) <= 122 and all(3 * i in stay and 3 * i + 2 in stay for i in range(60))


def test_slots_hold_similar_sets_at_any_row_count(spark):
    """A pair's slots depend on the pair alone; by the formula 0.9999 of pairs at 0.8 share one."""
    rng = np.random.default_rng(3)
    for shared, alone in ((40, 5), (4, 1), (320, 40)):
        for _ in range(150):
            common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (shared, alone, alone if shared > 4 else 0))
            x, y = (neardup.slots_of(np.concatenate([common, own]), neardup.TABLES, neardup.ROWS) for own in (a, b))
            assert (x == y).any()
    pair = [(i, " ".join(f"w{j + (i == 1 and j % 50 == 7)}" for j in range(150))) for i in range(2)]
    few = spark.createDataFrame(pair, "doc_id long, text string")
    many = few.union(spark.range(100, 3100).selectExpr("id", "concat('other ', id)"))
    got = [{r.doc_id: list(r.slots) for r in neardup.sets_of(df, 5).where("doc_id < 2").collect()} for df in (few, many)]
    assert got[0] == got[1] and set(got[0][0]) & set(got[0][1])


def classes_by_hand(texts, words=5):
    sets = {}
    for i, t in texts:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in sets}


def test_crowded_slots_and_the_exact_bound(spark, monkeypatch):
    """Texts around one passage crowd the slots; pairs among them are found, and nothing below 0.8."""
    monkeypatch.setattr(neardup, "CROWD", 6)
    rng = random.Random(8)
    fresh = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = fresh(200), []
    for _ in range(50):
        text = passage + fresh(34)
        rows += [text, text[:-12] + fresh(12)]  # 0.74 to the others, 0.90 to each other
    rows.append(fresh(9))
    rows.append(rows[-1][:8])  # 4 of 5 shingles: 0.8
    base = fresh(104)
    rows += [base, base[:94] + fresh(10), fresh(4) + base[:85]]
    texts = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = classes_by_hand(texts)
    got = {r.doc_id: r.root for r in neardup.similar_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    groups = lambda of: {frozenset(i for i in of if of[i] == r) for r in set(of.values())}
    assert groups(got) == groups(want)
    assert got[100] == got[101] and len(groups(got)) > 50


def test_copies_unlike_each_other_around_one_text(spark, monkeypatch):
    """Crowded slots of a text's copies at 0.7 to 0.9 from it: links as brute force finds them, without all pairs."""
    monkeypatch.setattr(neardup, "CROWD", 4)
    rng = random.Random(31)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    base, rows = fresh(150), []
    for k in range(90):
        text = base[:]
        for at in rng.sample(range(150), rng.randint(1, 6)):
            text[at : at + 1] = fresh(rng.randint(0, 2))
        rows.append(text)
        if k % 6 == 0:  # a copy of the copy, near it and maybe far from the base
            again = text[:]
            for at in rng.sample(range(len(again)), 3):
                again[at] = fresh(1)[0]
            rows.append(again)
    rows.append(base)
    texts = [(i, " ".join(t)) for i, t in enumerate(rows)]
    want = classes_by_hand(texts)
    made = []
    differing = neardup.differing
    monkeypatch.setattr(neardup, "differing", lambda *a: made.append(differing(*a)) or made[0])
    got = {r.doc_id: r.root for r in neardup.similar_classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    groups = lambda of: {frozenset(i for i in of if of[i] == r) for r in set(of.values())}
    assert groups(got) == groups(want)
    assert 3 < len(groups(got)) < 100 and made[0].count() < 400


def test_a_frequent_kind_hides_no_rare_pattern(spark):
    """Support is three seeds at any table size: 20 phones are enough beside 60,000 other seeds."""
    rows = [(i, f"some words then mobile number: +1 (212) 555-{1000 + i} and more") for i in range(20)]
    rows.append((100, "her mobile number: 0212 555 7788 is new"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    many = spark.range(1000, 4000).selectExpr("id doc_id", "array_join(transform(sequence(1, 20), i -> concat('w x u', id, 'v', i, '@example.org')), ' ') text")
    got = {r.doc_id: r.spans for r in pii.personal_data(df.union(many)).where("doc_id < 1000").collect()}
    assert got[100] == "phone:19:32"


def test_small_sources_of_a_large_mix_meet_their_targets(spark):
    """Blocks don't grow with the whole: 40 million words beside sources of 60 words."""
    large = spark.range(400).selectExpr("id doc_id", "repeat('w ', 100000) text", "'a' source")
    small = spark.range(1000, 1080).selectExpr("id doc_id", "repeat('w ', 15) text", "concat('b', id div 4) source")
    got = mixing.mixed(large.union(small)).where("source <> 'a'").groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()
    assert len(got) == 20 and all(abs(r.n - r.target) <= 2 * 16 for r in got)


def test_slots_are_ranked_and_take_the_block_of_their_rank(spark, monkeypatch):
    sources = spark.createDataFrame([("a", 0, 5000, 6000.0, 0), ("b", 1, 4000, 2500.5, 0), ("c", 2, 0, 0.0, 1), ("d", 3, 2000, 2499.5, 1)], "source string, sid long, source_size long, target double, part int")
    monkeypatch.setattr(mixing, "STRETCH", 50)
    want, ranks = [], Counter()
    for i in range(688):
        u = (i * mixing.PHI % (1 << 64)) / (1 << 64) * 11000
        sid = 0 if u < 6000 else 1 if u < 8500.5 else 3
        want.append((i, sid, ranks[sid]))
        ranks[sid] += 1
    assert sorted((r.slot, r.sid, r["rank"]) for r in mixing.slots_of(sources, 11000, 16).collect()) == want

    # a block without its slot isn't taken, whatever follows it
    slots_of = mixing.slots_of
    monkeypatch.setattr(mixing, "slots_of", lambda *how: slots_of(*how).where("rank % 5 <> 2"))
    rng = random.Random(12)
    rows = [(i, "s" if i % 3 else "t", " ".join("w" for _ in range(rng.choice([1, 7, 16, 40, 3000])))) for i in range(90)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    total = sum(r.size for r in got)
    for source in "st":
        own = sorted((r for r in got if r.source == source), key=lambda r: ((h := spark_hash_long(7, r.doc_id)) >> 32) % 64 * (1 << 65) + signed(h))
        size, share = own[0].source_size, own[0].target / total
        low, high = (0, share) if source == "s" else (1 - share, 1)
        n = sum(low <= (i * mixing.PHI % (1 << 64)) / (1 << 64) < high for i in range(-(-total // 16)))
        takes, at = [0] * len(own), 0
        owner = [j for j, r in enumerate(own) for _ in range(r.size)]
        for word in range(min(n * 16, 3 * size)):
            takes[owner[word % size]] += word // 16 % 5 != 2
        assert [r.taken for r in own] == takes


def test_the_stage_links_by_the_embedding(spark, monkeypatch):
    """Where no slot is shared, the operator's links join near-copies, and the exact check decides them."""
    shared_slots = neardup.shared_slots
    monkeypatch.setattr(neardup, "shared_slots", lambda nodes, name: shared_slots(nodes, name).where("false"))
    rng = random.Random(41)
    rows, prints = [], []
    for i in range(80):
        words = [f"e{rng.randrange(10**9)}" for _ in range(400)]
        rows.append((i, " ".join(words if i % 2 == 0 else [*rows[-1][1].split(), "end"])))
        own = rows[-1][1].split()
        hashes = {xxhash.xxh64_intdigest(" ".join(own[j : j + 5]), 42) for j in range(len(own) - 4)}
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    rows += [(100, rows[0][1] + " " + rows[0][1]), (101, None), (102, "")]
    got = {r.doc_id: r.root for r in neardup.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    joined = [got[i] == got[i + 1] for i in range(0, 80, 2)]
    assert joined == [(prints[i] ^ prints[i + 1]).bit_count() <= 2 for i in range(0, 80, 2)]
    assert 10 < sum(joined) < 40 and len({got[i] for i in range(0, 80, 2)}) == 40 and got[101] == got[102]

    # two sets of one fingerprint that aren't similar: the exact check parts them
    nodes = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, -1)], "node long, fp long")
    pairs = neardup.embedded(nodes)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (1, 3)}
    sets = spark.createDataFrame([(1, list(range(9))), (2, list(range(8))), (3, list(range(5, 14)))], "node long, shingles array<long>")
    assert [tuple(r) for r in neardup.alike(pairs, sets, "alike").collect()] == [(1, 2)]
