import base64
import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from weftline.llm.secrets import ALPHABET, LEAST_MEAN, LEAST_PART, LEAST_TOTAL, PIECE, SIGN_RATIO, found_secrets, joined, labelled_samples, op7_secrets, pair_ratios, redacted, secret_spans

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def brute(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)), [sum(k == x for _, _, k, _ in found) for x in ("assign", "access", "hex")]


TEXTS = [
    None, "", "nothing here", "password=hunter22", "PassWord : 'abcdef' token=abc secret: \"x.y-z=_+/9\"", "api_key=123456apikey: 1234567", "passwd==abcdef", "token:  short secret=longer1",
    "é中😀 password=hunter22 😀 secret=abcdefg", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 14, "xAKIA" + "0" * 30 + "y", "akia" + "a" * 20, "0123456789abcdef" * 2, "f" * 23, "F" * 30, "g" + "f" * 24 + "g" + "e" * 25,
    "secret=" + "ab12" * 8, "password=\nabcdefgh", "tokenx=abcdefgh", "token\t=abcdefgh", 'token"  =  "abcdefgh"', "secret:secret:abcdef", "ſecret=abcdefgh", "toKen=abcdefgh", "password=a" * 3000, "token = " + "z" * 20_000,
]


@pytest.fixture(scope="module")
def ratios(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return pair_ratios(labelled_samples(docs))


def test_base_spans(spark, ratios):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(4)
    found = secret_spans(docs, ratios).select("doc_id", joined(F.col("base")).alias("b"), *(F.size(k).alias(k) for k in ("assign", "access", "hex"))).collect()
    for r in found:
        assert (r.b, [r.assign, r.access, r["hex"]]) == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id][:80]


def markov_brute(text, ratios):
    """Spans of the model, character by character over the text with blanks for its base spans."""
    chars = list(text or "")
    for span in filter(None, brute(text)[0].split(",")):
        _, a, b = span.split(":")
        chars[int(a) : int(b)] = " " * (int(b) - int(a))
    code = {c: i + 1 for i, c in enumerate(ALPHABET)}
    spans = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", "".join(chars)):
        run, parts = m[0], []

        def close(first, last, peak, run=run, parts=parts):
            if peak < LEAST_TOTAL:
                return
            a, b = first, last
            while a > 0 and run[a - 1] not in "/_=-":
                a -= 1
            while b < len(run) and run[b] not in "/_=-":
                b += 1
            if last - first >= LEAST_PART and peak >= LEAST_MEAN * (last - first - 1) or b - a >= LEAST_PART and peak >= LEAST_MEAN * (b - a - 1):
                if parts and a < parts[-1][1]:
                    parts[-1][1] = max(parts[-1][1], b)
                else:
                    parts.append([a, b])

        total = peak = 0.0
        first = last = 0
        for i in range(1, len(run)):
            total += float(f"{ratios[code[run[i - 1]] * 68 + code[run[i]]]:.5f}")
            if total <= 0 or total < peak - LEAST_TOTAL:
                close(first, last, peak)
                total, peak, first, last = 0.0, 0.0, i, i
            elif total > peak:
                peak, last = total, i + 1
        close(first, last, peak)
        spans += [(m.start() + a, m.start() + b) for a, b in parts]
    return spans


def compared(spark, ratios, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in secret_spans(df, ratios).select("doc_id", "markov", joined(F.col("base")).alias("b")).collect():
        assert [(s.start, s.end) for s in r.markov] == markov_brute(texts[r.doc_id], ratios), texts[r.doc_id][:200]
        assert r.b == brute(texts[r.doc_id])[0]


def test_ratios_against_brute_force(spark):
    docs = spark.createDataFrame([(1, "some ordinary words_and-more words_and-more"), (2, None), (3, "x9")], "doc_id long, text string")
    samples = labelled_samples(docs)
    counts = {}
    for r in samples.collect():
        for a, b in zip(r["sample"], r["sample"][1:], strict=False):
            for key in ((r.secret, a, b), (r.secret, a, None)):
                counts[key] = counts.get(key, 0) + 1
    found = pair_ratios(samples)
    for i, a in enumerate(ALPHABET):
        for j, b in enumerate(ALPHABET):
            shares = [(counts.get((k, a, b), 0) + 0.5) / (counts.get((k, a, None), 0) + 0.5 * 68) for k in (1, 0)]
            expected = math.log(shares[0] / shares[1]) if (a + b).isalnum() else SIGN_RATIO
            assert found[(i + 1) * 68 + j + 1] == pytest.approx(expected), (a, b)


def test_markov_spans_against_brute_force(spark, ratios):
    rng = random.Random(2)
    keys, path = random_strings(40), "production/authentication_configuration-service"
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + TEXTS + SLUGS + ORDINARY
    for _ in range(150):
        pieces = [rng.choice([rng.choice(keys)[: rng.randint(5, 36)], path[: rng.randint(1, 40)], "0123456789abcdef" * 2, "password=hunter22", "é", "word", "+", "12345678901234567890"]) for _ in range(rng.randint(1, 12))]
        texts.append("".join(x + rng.choice([" ", "/", "-", "_", "=", "", "\n"]) for x in pieces))
    compared(spark, ratios, texts)


def test_long_texts_are_cut_where_no_match_crosses(spark, ratios):
    rng = random.Random(3)
    keys = random_strings(50)
    atoms = ["password = abcdefgh", "token:\"x1y2z3\"", "secret  :   'k'", "0123456789abcdef" * 2, "AKIA" + "Z9" * 9, " ", "  ", " = ", ":", '"', "'", ".", "é😀", "words here and there ", "\n", "api_key" + " " * 30 + "=" + " " * 30 + "qwertyuiop"]
    texts = ["".join(rng.choice(atoms + keys) + rng.choice(["", " ", " "]) for _ in range(rng.choice([300, 900]))) for _ in range(25)]
    texts += ["token = abcdefgh " * 900, "token = " * 900, "a" * 30_000, " " * 9000 + "=" + " " * 9000, "".join(keys) * 8, "\n" * 5000, ("x" * 1999 + " token = abcdefgh ") * 3, ("x" * 1985 + " token = abcdefgh ") * 3]
    pieces = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_extract_all("t", F.lit(PIECE), F.lit(0)).alias("p")).collect()
    assert all("".join(r.p) == r.t for r in pieces) and max(len(r.p) for r in pieces) > 5
    compared(spark, ratios, texts)
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", found_secrets(F.col("t"), ratios, "[X]").alias("f"))
    df = df.select("t", "f.clean", F.array_sort(F.concat("f.assign", "f.access", "f.hex", "f.markov")).alias("s"))
    for r in df.collect():
        out, at = [], 0
        for s in r.s:
            if s.start >= at:
                out.append(r.t[at : s.start] + "[X]")
            at = max(at, s.end)
        assert r.clean == "".join(out) + r.t[at:]


def test_many_runs_in_one_text_take_linear_time(spark, ratios):
    keys = random_strings(500)
    text = " ".join(keys[i % 500][: 20 + i % 3] for i in range(200_000))
    began = time.monotonic()
    r = secret_spans(spark.createDataFrame([(text,)], "text string"), ratios).select(F.size("markov").alias("n"), F.element_at("markov", -1)["end"].alias("end")).first()
    assert r.n > 190_000 and r.end == len(text) and time.monotonic() - began < 60


def test_held_out_recall_and_precision(spark, ratios):
    """Random strings that no model has seen, by length, in letters and digits; words and slugs of documents that it has not seen."""
    rng = random.Random(7)
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (16, 20, 24, 32, 64):
        found = marked(spark, ratios, [f"see {''.join(rng.choice(signs) for _ in range(n))} there" for _ in range(200)])
        assert sum(map(bool, found)) >= 180, n
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").collect() for w in re.findall(r"[a-z]{4,12}", r.text or "")})
    slugs = ["-".join(rng.choice(words) for _ in range(4)) for _ in range(200)] + ["".join(rng.choice(words).title() for _ in range(4)) for _ in range(200)]
    assert sum(map(bool, marked(spark, ratios, slugs))) <= 8


def random_strings(n):
    out = []
    for i in range(n):
        digest = hashlib.sha512(str(i).encode()).digest()
        out.append("".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[b % 62] for b in digest[:36]))
    return out


ORDINARY = ["getUserAccountSettingsFromDatabase", "internationalization", "the_quick_brown_fox_jumps_over", "Donaudampfschifffahrtsgesellschaft", "http/path/to/some/resource/index", "1234567890123456789", "MAX_CONNECTION_POOL_SIZE", "============================", "----------------------------", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def test_models_tell_random_strings_from_identifiers(spark, ratios):
    rows = [(i, f"key {s} end") for i, s in enumerate(random_strings(60))] + [(100 + i, f"key {s} end") for i, s in enumerate(ORDINARY)]
    found = {r.doc_id: [(s.start, s.end) for s in r.markov] for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ratios).select("doc_id", "markov").collect()}
    assert sum(found[i] == [(4, 40)] for i in range(60)) >= 57
    assert all(found[100 + i] == [] for i in range(len(ORDINARY))), [s for i, s in enumerate(ORDINARY) if found[100 + i]]


def test_added_spans_overlap_no_base_span(spark, ratios):
    secret = random_strings(1)[0]
    docs = spark.createDataFrame([(1, f"password={secret} {secret}")], "doc_id long, text string")
    r = secret_spans(docs, ratios).select(joined(F.col("spans")).alias("s")).first()
    assert r.s == f"assign:0:{9 + len(secret)},markov:{10 + len(secret)}:{10 + 2 * len(secret)}"


def marked(spark, ratios, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.markov) for r in secret_spans(df, ratios).select("doc_id", "text", "markov").collect()}
    return [[found[i][0][s.start : s.end] for s in found[i][1]] for i in range(len(texts))]


def test_keys_in_long_paths_are_found_and_the_path_stays(spark, ratios):
    path = "production/authentication/configuration/service/account/internal/credentials/"
    for n, least in ((16, 54), (24, 58)):
        keys = [k[:n] for k in random_strings(60)]
        assert sum(x == [k] for x, k in zip(marked(spark, ratios, [path + k for k in keys]), keys, strict=True)) >= least
        assert sum(x == [k] for x, k in zip(marked(spark, ratios, [f"{path}{k}/{path}end" for k in keys]), keys, strict=True)) >= least
    keys = random_strings(60)
    two = marked(spark, ratios, [f"{a}/{path}{b}" for a, b in zip(keys, keys[1:], strict=False)])
    assert sum(x == [a, b] for x, a, b in zip(two, keys, keys[1:], strict=False)) >= 55
    assert sum(k in "".join(x) for x, k in zip(marked(spark, ratios, [f"productionAuthenticationConfigurationServiceAccountInternalCredentials{k}" for k in keys]), keys, strict=True)) >= 57


SLUGS = [
    "the-quick-brown-fox-jumps-over-lazy", "well-known-open-source", "Content-Type-Options-nosniff", "en/news/world-europe-12345678", "jack-of-all-trades", "2024-05-17/report-of-the-year",
    "the+quick+brown+fox+jumps+over", "name=value/other=thing", "2023/11/30/how-to-write-tests", "state-of-the-art-methods", "src/main/resources/application-production", "X-Forwarded-Protocol-Version",
]


def test_slugs_headers_and_dated_paths_are_ordinary(spark, ratios):
    found = marked(spark, ratios, [f"see {x} here" for x in SLUGS])
    assert not any(found), [x for x, f in zip(SLUGS, found, strict=True) if f]


def test_ordinary_samples_come_from_all_documents_and_hold_joined_words(spark):
    docs = spark.createDataFrame([(i, f"word{i:05d} well-known_x") for i in range(2500)], "doc_id long, text string")
    found = {r[0] for r in labelled_samples(docs).where("secret = 0").select("sample").collect()}
    assert "well-known_x" in found and sum(x.startswith("word") for x in found) == 2500


def test_keys_with_signs_are_found(spark, ratios):
    keys = [base64.b64encode(hashlib.sha512(str(i).encode()).digest()[:30]).decode() for i in range(60)]
    found = marked(spark, ratios, [f"key {k} end" for k in keys])
    assert sum(sum(map(len, x)) >= 36 for x in found) >= 54


def test_keys_beside_base_spans_are_found(spark, ratios):
    keys = random_strings(30)
    assert sum(x == [k] for x, k in zip(marked(spark, ratios, [f"{'0123456789abcdef' * 2}/{k}" for k in keys]), keys, strict=True)) >= 28


def test_redaction_and_clashing_columns(spark, ratios):
    docs = spark.createDataFrame([(1, "é password=hunter22 and 0123456789abcdef01234567!", "x"), (2, None, "y"), (3, "clean", "z")], "doc_id long, text string, spans string")
    found = {r.doc_id: r.t for r in secret_spans(docs, ratios).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert found == {1: "é [SECRET] and [SECRET]!", 2: None, 3: "clean"}


def test_overlapping_spans_are_redacted_together(spark, ratios):
    docs = spark.createDataFrame([(1, "secret=" + "ab12" * 8 + " x")], "doc_id long, text string")
    assert secret_spans(docs, ratios).select(redacted(F.col("text"), F.col("spans"))).first()[0] == "[SECRET] x"


def test_empty_tables_and_no_python(spark, ratios):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_spans(docs, ratios).collect() == [] and len(pair_ratios(labelled_samples(docs))) == len(ratios)
    plan = secret_spans(docs, ratios)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = op7_secrets(spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(texts)
    for r in found:
        base, counts = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == counts
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
