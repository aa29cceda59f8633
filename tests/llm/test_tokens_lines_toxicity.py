import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import docs, edge_docs, edge_rows, empty_docs, prose
from tidemark.llm import linededup, tokenids, toxicity
from tidemark.llm.queries import op6_toxicity

# --- token ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1))))
def test_code_round_trip(ranks):
    control, data = tokenids.pack(np.array(ranks, np.uint32))
    assert tokenids.unpack(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)
    assert len(data) == sum(max(1, (r.bit_length() + 7) // 8) for r in ranks)


def check_encoder(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenids.vocabulary_path())
    ids, n = tokenids.Encoder(tokenids.vocabulary_path()).encode(pa.array(texts, pa.string()))
    want = [library.encode(t or "", add_special_tokens=False).ids + [tokenids.END_ID] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_encoder_equals_the_library():
    texts = [r[1] for r in edge_rows()]
    texts += ["It's 12,5 a.b. end.. don't stop İΣ Aéx, <|endoftext|>. x<|startoftext|>y 1. (a). É. \x1c  b", "a,b,.c ... , . 'S 'll", "İ! ǅ. ŉ ĸ' e\u0301. é\u0301! \u0301a ª. \x01 a\x01b"]
    check_encoder(texts)


MIXED = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAbtTsSİıßΣσς'’.,!<|>  \n\u0301\u0307éÉǄǅ1٣中")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts=st.lists(MIXED, min_size=1, max_size=8))
def test_encoder_equals_the_library_over_unicode(texts):
    check_encoder(texts)


def test_chunks_do_not_show(monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(60)] + [None, ""]
    monkeypatch.setattr(tokenids, "CHUNK", 500)
    check_encoder(texts)


def check_tokens(rows, out):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenids.vocabulary_path())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [tokenids.END_ID]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(out, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_files_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 90), 3000)) for i in range(300)]
    check_tokens(rows, tokenids.read(spark, tokenids.write(docs(spark, rows))).collect())
    check_tokens(edge_rows(), tokenids.read(spark, tokenids.write(edge_docs(spark))).collect())
    assert tokenids.read(spark, tokenids.write(empty_docs(spark))).collect() == []


# --- line dedup


def brute_strip(rows, spread):
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites[line.strip(" \t\n\x0b\x0c\r")].add(r[2] if len(r) > 2 else "s0")
    bad = {k for k, v in sites.items() if k and len(v) >= spread}
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\n\x0b\x0c\r") not in bad]
        yield r[0], None if r[1] is None else "\n".join(kept), 0 if r[1] is None else len(lines), len(lines) - len(kept)


def test_lines_equal_brute_force(spark):
    rng = random.Random(4)
    common = [prose(rng, 60) for _ in range(20)]
    rows = []
    for i in range(400):
        lines = [prose(rng, 6) for _ in range(3)] + [common[k] + rng.choice(["", " ", "\t"]) for k in range(20) if rng.random() < 0.3 and i % 20 <= k] + rng.choice([[], ["", " "]])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"site{i % 20}"))
    for spread in (3, 8, 19):
        got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.strip_lines(docs(spark, rows), spread=spread).collect())
        assert got == sorted(brute_strip(rows, spread))
        assert any(r[3] for r in got)


def test_line_edges(spark):
    out = linededup.strip_lines(edge_docs(spark), spread=2)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted(brute_strip(edge_rows(), 2), key=str)
    assert out.columns == [*edge_docs(spark).columns, "n_lines", "n_removed"]
    assert linededup.strip_lines(empty_docs(spark)).collect() == []


def test_near_threshold_lines_are_exact(spark):
    rows = [(i, f"line {i % 5}", f"site{i // 5}") for i in range(60)]
    out = linededup.boilerplate(docs(spark, rows), spread=12).collect()
    assert len(out) == 5 and all(r.exact and r.sites == 12 for r in out)


# --- toxicity


def kinds(text):
    return {k: n for k, n in zip(toxicity.KINDS, toxicity.Grammar().clauses(text)) if n}


def test_grammar():
    assert kinds("You are a stupid person.") == {"insult_at_target": 1}
    assert kinds("What a stupid plan") == {"insult": 1}
    assert kinds("stupid, stupid plan") == {"insults": 1}
    assert kinds("stupid, stupid and pathetic, he is; and so are these idiots") == {"insults_at_target": 1, "insult": 1}
    assert kinds("They are far from here and no one knows why the trash. I kill and punish it") == {"insult_at_target": 1, "threat": 1}
    assert kinds("He is not an idiot.") == {"negated": 1}
    assert kinds("She said that plan is garbage. Trash!") == {"reported": 1, "insult": 1}
    assert kinds("I will kill you") == {"threat_at_target": 1}
    assert kinds("how to kill a process") == {"threat": 1}
    assert kinds("not one of them would ever say that. you idiot") == {"insult_at_target": 1}
    assert kinds("a nice day") == {} and kinds("") == {}


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Tu es un idiot", "insult_at_target"), ("tu n'es pas un idiot", "negated"), ("Il dit que c'est un connard", "reported"), ("je vais vous frapper", "threat_at_target"),
        ("Du bist ein Trottel", "insult_at_target"), ("er ist kein Idiot, nie Versager", "negated"), ("sie sagte, das Pack ist Abschaum", "reported"), ("ich werde dich schlagen", "threat_at_target"),
        ("usted es basura", "insult_at_target"), ("no es un idiota", "negated"), ("ella dijo que todo es escoria", "reported"), ("los voy a matar a ellos", "threat_at_target"),
    ],
)
def test_targets_negation_and_report_in_four_languages(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize("text", ["¡idiota!", "„Idiot“", "«connard»", "«\u00a0connard\u00a0»", "“idiot”", "idiot…", "so—idiot—so", "‹débile›", "¿imbécil?"])
def test_words_end_at_any_punctuation(text):
    assert kinds(text) == {"insult": 1}
    assert kinds(f"you {text}") == {"insult_at_target": 1}


def test_threats_and_learned_words_end_at_any_punctuation():
    assert kinds("„I will kill you…“") == {"threat_at_target": 1} and kinds("“kill”") == {"threat": 1}
    found = toxicity.Grammar(frozenset(["zorgle"])).clauses("¡zorgle! «zorgle»")
    assert sum(found[:-1]) == 2 and found[-1] == 2


def test_the_filter_drops_no_match():
    rng, grammar = random.Random(8), toxicity.Grammar(frozenset(["zorg*", "plim"]), frozenset(["wor*"]))
    parts = ["zorgles", "zorg", "zor", "plim", "plims", "idiot", "kill", "connard", "débile", "you", "not", "said", "word", "Ärger", "x_y"]
    for _ in range(500):
        text = "".join(rng.choice(parts) + rng.choice([" ", ".", "\u00a0", "…", "”", " “", "»", "¡", "—", "\u3000", "'", "’", "_", "é"]) for _ in range(rng.randrange(6)))
        symbols = [grammar._symbol(w) for w in grammar._WORDS.findall(text.lower())]
        whole = list(grammar.machine.run([*symbols, "b"]))
        assert grammar.clauses(text)[:-1] == [whole.count(k) for k in toxicity.KINDS]


def test_composition_equals_running_in_turn():
    rng = random.Random(1)
    chain = [toxicity._negation(), toxicity._reported(), toxicity._clauses()]
    whole = chain[0].compose(chain[1]).compose(chain[2])
    for _ in range(300):
        symbols = [rng.choice("NbRYoITS") for _ in range(rng.randrange(25))]
        step = list(symbols)
        for t in chain:
            step = list(t.run(step))
        assert list(whole.run(symbols)) == step


def test_held_out_labels(spark):
    table = SMALL.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{table}/labels.parquet")
    out = op6_toxicity(spark, table)
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    insulted = [r.predicted for r in rows if r.toxic == 1 and any(r[k] for k in toxicity.KINDS)]
    assert sum(clean) / len(clean) < 0.02 and sum(insulted) / len(insulted) > 0.9 and len(insulted) > 5
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs_, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs_, x).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (6, 1), (6, 0), (999, 1)], "doc_id long, toxic int")
    out = toxicity.score(edge_docs(spark), labels).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
    assert toxicity.score(empty_docs(spark), labels).collect() == []
    assert toxicity.score(edge_docs(spark), labels.limit(0)).count() == len(edge_rows())


def test_beginnings_are_learned_from_labels(spark):
    """No word stands often enough to be learned, but their common beginning does."""
    rng, letters = random.Random(13), str.maketrans("0123456789", "abcdefghij")
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(rng, 40, 300).translate(letters).split(), i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "brankü" + "".join(rng.choice("abcdefgh") for _ in range(3)))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.learn_words(docs(spark, rows), known.filter(~toxicity.held_out())) == ({"brankü*"}, set())
    out = {r.doc_id: r for r in toxicity.score(docs(spark, rows), known).collect()}
    assert all(out[i].predicted == t for i, t in labels)


def test_counts_are_not_clipped(spark):
    rows = [(n, "you idiot. " * n) for n in (1, 2, 4, 8, 64, 512)]
    out = sorted(toxicity.score(docs(spark, rows), spark.createDataFrame([], "doc_id long, toxic int")).collect())
    assert [r.insult_at_target for r in out] == [1, 2, 4, 8, 64, 512]
    logits = [np.log(r.score / (1 - r.score)) for r in out]
    np.testing.assert_allclose(logits, [toxicity.BIAS + toxicity.PRIOR[1] * k for k in (1, 2, 3, 4, 7, 10)], rtol=1e-6)


def brute_clauses(text, insults, slurs):
    """Kinds of a text, clause by clause, without a machine."""
    grammar, out = toxicity.Grammar(insults, slurs), Counter()
    for clause in re.split(r"[.!?;:\n|]", text.lower()):
        insults = threats = negated = reported = slurs = 0
        since, heard, words = 99, False, re.findall(r"[\w']+", clause)
        target = any(grammar._symbol(w) == "Y" for w in words)
        for w in words:
            s, near = grammar._symbol(w), since < toxicity.REACH
            since += 1
            if s == "N":
                since = 0
            elif s == "R":
                heard = True
            elif s == "S":
                slurs += not near and not heard
            elif s in "IT":
                negated += near
                reported += heard and not near
                insults += s == "I" and not near and not heard
                threats += s == "T" and not near and not heard
                since = 99
        at = "_at_target" * target
        out[("insult" if insults == 1 else "insults") + at] += insults > 0
        out["threat" + at] += threats > 0
        out["negated"] += negated > 0
        out["reported"] += reported > 0
        out["slur"] += slurs > 0
        out["clauses"] += bool(words)
    return [out[k] for k in (*toxicity.KINDS, "clauses")]


def test_clauses_equal_brute_force():
    rng, learned = random.Random(15), (frozenset(["zorg*", "plim"]), frozenset(["zorgu*", "meh"]))
    grammar = toxicity.Grammar(*learned)
    for _ in range(800):
        text = " ".join(rng.choice(["zorgle", "zorgus", "meh", "plim", "idiot", "kill", "you", "not", "said", "word", "so", "a", ".", ";"]) for _ in range(rng.randrange(30)))
        assert grammar.clauses(text) == brute_clauses(text, *learned), text


def test_insults_are_learned_from_labels(spark):
    """An invented word that marks toxic texts is learned; words of one text that was copied often, and words
    that stand in clean texts too, are not."""
    rng, letters = random.Random(12), str.maketrans("0123456789", "abcdefghij")
    rows, labels = [], []
    for i in range(900):
        words, toxic = prose(rng, 40, 300).translate(letters).split(), i % 6 == 0
        if toxic:
            for w in rng.sample(["zorgling", "Kwéfnar", "blatherskite"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    copied = "onlyhere standing " + prose(rng, 30, 300).translate(letters)
    rows += [(2000 + i, copied) for i in range(60)]
    labels += [(2000 + i, 1) for i in range(60)]
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned, slurs = toxicity.learn_words(docs(spark, rows), known.filter(~toxicity.held_out()))
    assert learned == {"zorgling", "kwéfnar", "blatherskite"} and not slurs
    out = {r.doc_id: r for r in toxicity.score(docs(spark, rows), known).collect()}
    held = [(out[i], t) for i, t in labels if i < 2000 and out[i].held_out]
    assert len(held) > 200 and all(r.predicted == t for r, t in held)
    assert toxicity.learn_words(docs(spark, rows), known.limit(0)) == (frozenset(), frozenset())


def test_learned_words_equal_brute_force(spark):
    """All words and beginnings counted text by text, and the rules applied to each."""
    rng, letters = random.Random(21), str.maketrans("0123456789", "abcdefghij")
    rows, labels = [], []
    for i in range(700):
        words, toxic = prose(rng, 30, 200).translate(letters).split(), i % 5 == 0
        for _ in range(3 if toxic else int(i % 9 == 0)):
            words.insert(rng.randrange(len(words)), rng.choice(["grobian", "grobiano", "stinker", "stinkend", "schuft"]))
        if toxic and rng.random() < 0.7:
            words.insert(rng.randrange(len(words)), "lumpenhund")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    texts = [(t.lower().split(), y) for (_, t), (_, y) in zip(rows, labels)]
    docs_of, places, before, size = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(set), [0, 0]
    share = sum(y for _, y in labels) / len(labels)
    for words, y in texts:
        size[y] += len(words)
        parts = [[w, *(w[:k] + "*" for k in range(4, min(len(w), 9)))] for w in words]
        for x in {x for p in parts for x in p}:
            docs_of[x][y] += 1
        for p, v in zip(parts, ["", *words]):
            for x in p:
                places[x][y] += 1
                if y:
                    before[x].add(v)
    sure, slur = {}, {}
    for x, (c, t) in docs_of.items():
        p = t / (c + t)
        far = (c + t) * (p * np.log(p / share) + ((1 - p) * np.log((1 - p) / (1 - share)) if p < 1 else 0)) if t else 0
        if p > share and t >= 3 and far >= np.log(100 * (len(docs_of) + 1)):
            if p >= 0.85:
                sure[x] = t
            elif places[x][1] * size[0] >= 8 * places[x][0] * size[1]:
                slur[x] = t
    want = [toxicity._gathering(sure, sure), toxicity._gathering(slur, sure | slur)]
    want = tuple({x for x in s if len(before[x]) >= 3} for s in want)
    assert toxicity.learn_words(docs(spark, rows), known) == want and want[0] and want[1]


def test_weights_are_most_probable():
    """At the weights found no small change makes the labels more probable, but for weights held at zero."""
    rng = random.Random(3)
    histogram = Counter()
    for _ in range(400):
        x = tuple(rng.choice([0, 0, 1, 2]) for _ in toxicity.PRIOR)
        histogram[x, int(rng.random() < 1 / (1 + np.exp(3 - x[1] - 2 * x[3])))] += 1
    rows = [(x, y, n) for (x, y), n in histogram.items()]
    w = np.array(toxicity.fit(rows))
    guess = np.array([*toxicity.PRIOR, toxicity.BIAS])

    def loss(v):
        z = np.array([np.dot(x, v[:-1]) + v[-1] for x, _, _ in rows])
        return sum(n * (np.logaddexp(0, s) - y * s) for s, (_, y, n) in zip(z, rows)) + 0.05 * ((v - guess) ** 2).sum() / 2

    if (w[:-1] > 0).all():
        assert all(loss(w + d * np.eye(len(w))[k]) >= loss(w) - 1e-9 for k in range(len(w)) for d in (1e-3, -1e-3))
    assert w[1] > 0.5 and w[3] > w[1]


def test_slurs_count_by_their_share(spark):
    """Words that clean texts have too, but seldom, tell where they are many; one of them tells nothing."""
    rng, letters = random.Random(14), str.maketrans("0123456789", "abcdefghij")
    rows, labels = [], []
    for i in range(1500):
        words, toxic = prose(rng, 60, 300).translate(letters).split(), i % 8 == 0
        for _ in range(6 if toxic else i % 3 == 0):
            words.insert(rng.randrange(len(words)), rng.choice(["skwarn", "skwarnel", "skwarnig"]))
        rows.append((i, "".join(w + rng.choice([" ", " ", ". "]) for w in words)))
        labels.append((i, int(toxic)))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    learned, slurs = toxicity.learn_words(docs(spark, rows), known.filter(~toxicity.held_out()))
    assert not learned and slurs and all(w.startswith("skwarn") for w in slurs)
    out = {r.doc_id: r for r in toxicity.score(docs(spark, rows), known).collect()}
    wrong = [i for i, t in labels if out[i].held_out and out[i].predicted != t]
    assert len(wrong) < 5 and not any(out[i].predicted for i in wrong)
