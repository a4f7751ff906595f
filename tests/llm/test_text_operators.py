"""Look-alike text, personal information, quality statistics, languages and defective responses."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import defects, langid, pii, quality, queries, skeleton

# ---------------------------------------------------------------- 3


def test_skeletons():
    same = [("ﬁrst aid", "first aid"), ("Ｆｕｌｌ　ｗｉｄｅ", "Full wide"), ("café", "café"), ("pаypаl", "paypal"), ("a b c", "a b c"), ("he​l­lo﻿", "hello"), ("ｅ́", "é"), ("ё", "ë"), ("𝐛old", "bold")]
    for a, b in same:
        assert skeleton.skeleton(a) == skeleton.skeleton(b), (a, b)
        assert skeleton.consistent(a) == skeleton.consistent(b)
    for a, b in [("O", "0"), ("l", "I"), ("A", "a"), ("e", "é"), ("a b", "a  b"), ("x²", "x2"), ("it's", "it’s"), ("a\nb", "a b")]:
        assert skeleton.skeleton(a) != skeleton.skeleton(b), (a, b)
    assert skeleton.skeleton(None) is None and skeleton.skeleton("") == ""
    assert all(skeleton.skeleton(skeleton.skeleton(chr(c))) == skeleton.skeleton(chr(c)) for c in range(0x20, 0x3000) if not 0xD800 <= c <= 0xDFFF)


def test_letters_of_many_scripts():
    shown = {"к": "k", "ո": "n", "ⲟ": "o", "ꓮ": "A", "ꮯ": "c", "ѵ": "v", "ꜱ": "s", "ʏ": "y", "ᴋ": "k", "ı": "i", "𐐬": "o", "ꮪ": "s", "ԍ": "g", "ꓢ": "S", "𝓪": "a", "ｚ": "z"}
    for a, b in shown.items():
        assert skeleton.consistent(a) == b, a
    assert len(skeleton.LOOK_ALIKES.split()) // 2 <= 200


def test_a_confusables_file_extends_the_table(tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# comment\n0B66 ;\t006F ;\tMA\t# digit\n0031 ; 006C ; MA\n", encoding="utf-8")
    assert skeleton.consistent("\u0b66k 1", str(f)) == "ok 1" and skeleton.consistent("\u0b66k") == "\u0b66k"


def test_look_alike_pairs_are_all_pairs_of_different_variants(spark):
    rows = [(1, ["paypal", "x"]), (2, ["pаypal", "x"]), (3, ["paypal", "x"]), (4, ["paypal"]), (5, None), (6, None), (7, [None]), (8, [""]), (9, ["pаypаl", "x"])]
    df = spark.createDataFrame(rows, "rec_no long, texts array<string>").withColumn("rec", F.lit("clash"))
    got = {(r.rec_a, r.rec_b) for r in skeleton.look_alike_pairs(skeleton.look_alike_groups(df, "rec_no", "texts")).collect()}
    assert got == {(1, 2), (2, 3), (1, 9), (3, 9), (2, 9)}
    classes = {r.rec: (r.class_rec, r.variant_rec, r.links) for r in skeleton.look_alike_classes(skeleton.look_alike_groups(df, "rec_no", "texts")).collect()}
    assert classes == {1: (1, 1, 2), 3: (1, 1, 2), 2: (1, 2, 3), 9: (1, 9, 3), 4: (4, 4, 0), 5: (5, 5, 0), 6: (5, 5, 0), 7: (7, 7, 0), 8: (8, 8, 0)}
    assert skeleton.look_alike_pairs(skeleton.look_alike_groups(df.limit(0), "rec_no", "texts")).count() == 0


# ---------------------------------------------------------------- 1

TURNS = {
    "phone": ["call me on 0-e1ght-0-0-n1ne-f1ve-f1ve-0n3-f1ve-thr33 now", "likh lo ০১১৩৪৭৭১৫২ bhai", "it is zero double seven 2 five six double three double six", "ring +91 98765 43210 today", "363 555 Ol68 is mine", "Zero, Six, Four, One, Nine, Three, Nine, Five, Two, Zero"],
    "email": ["write to loft_host@letters.example.org soon", "l o f t 2 @ l e t t e r s . e x a m p l e . o r g", "bills at example dot com please", "stay.palm2006 [at] inboxly [dot] example"],
    "id_number": ["licence DL51-2004-0048605 here", "pan KEEXM0922F", "ssn 952-10-0361", "my ssn is 123 45 6789", "passport number: L8899001"],
    "street_address": ["Flat 23B, Tower 6, Velpello Residency, Peacock Road, Velpello", "come to 404/C copper st apt 5 holmpedor", "Tamarindweg Nr. 114, 19723 Velribay", "house no. 392, gali 6, quarry nagar, Orushanagar 121924", "calle Tamarind 171, piso 4", "Lindenstr. 44, 80331 Muenchen", "7 bis rue de la Paix, Lyon", "Flat 4B Sunrise Apartments, Kochi"],
    "person_name": ["My name is Salma Ruthmoodi and I wait", "Mera naam Kabir hai", "We saw Dr Vandrel writing about it", "Regards, Mrs Lind"],
    None: ["Villa Farid was soaked", "Clara's Bakery sells bread", "Slate Road near Wentador is sunny", "pay tiny57@okdemobank", "Telegram @sunny_rental3", "INV 2026-3562463 is due", "parcel ZX2462332 came", "t.me/villa", "see www dot lodge dot example slash sunny655", "You will find 30 hooks", "Invoice 2026-884412 is open", "THE PAINTER LEFT THE LAMP IN THE HALL"],
}


@pytest.mark.parametrize("kind", list(TURNS))
def test_recognisers(kind):
    for text in TURNS[kind]:
        got = {c[1] for c in pii.scan([text])} - {"coded", "number", "name", "opening", "words"}
        assert got == ({kind} if kind else set()), (text, got)


def test_runs_of_capitalised_words():
    runs = lambda t: [(t[a:b], s) for a, b, s, _, _ in pii.words_and_runs(t, [])[0]]
    assert runs("please tell Priya Sharma that my wife Meera met Dr. A. Belo") == [("Priya Sharma", 1), ("Meera", 1), ("Dr. A. Belo", 2)]
    assert runs("the keys of Villa Meera and Meera's Cafe near Slate Road") == [] and runs("ALL OF IT IN CAPITALS BY MEERA") == []
    assert runs("Thanks, it was MATEO YARURST") == [("MATEO YARURST", 0)] and runs("") == []
    assert [w for w, _, _ in pii.words_and_runs("mera naam kabir hai", [])[1]] == ["naam", "kabir"]


def test_pieces_over_turns():
    kinds = lambda texts: {k: [x[0] for x in v] for k, v in pii.pieces(texts).items()}
    assert kinds(["hello there", "then zero one eight", "note five five five next", "last part is 4455"]) == {2: ["phone"], 3: ["phone"], 4: ["phone"]}
    assert kinds(["billspalm19", "first bit: at postbox", "and dot example after that"]) == {1: ["email"], 2: ["email"], 3: ["email"]}
    assert kinds(["insta", "desk_", "cedar20"]) == {} and kinds(["then 12"]) == {} and kinds([]) == {}
    # a piece may stand beside other sentences, however long the turn is
    talk = "We came home late and the lamp in the hall was broken, so the cook lit a candle and read to us. " * 3
    long = [f"{talk}Then 98765. {talk}", "ok sure", f"{talk}\nnext is 43210."]
    got = pii.pieces(long)
    assert {k: [long[k - 1][a:b] for _, a, b in v] for k, v in got.items()} == {1: ["98765"], 3: ["43210"]}


def test_contexts_decide_open_numbers(spark):
    seeds = [f"reach me on ०{i:09d} about it" for i in range(20)] + [f"Reservation {i:08d} was confirmed" for i in range(20)]
    rows = [("t", i, [s]) for i, s in enumerate(seeds)] + [("t", 100, ["reach me on 9845550164 about it"]), ("t", 101, ["Reservation 4712007120 was confirmed"]), ("t", 102, None), ("t", 103, [None, ""])]
    df = spark.createDataFrame(rows, "tbl string, rec_no long, texts array<string>")
    got = {r.rec_no: r.kind for r in pii.disclosed_spans(df).filter("rec_no >= 100").collect()}
    assert got == {100: "phone"}
    texts = {r.rec_no: r.text for r in pii.redacted_turns(df).filter("turn_no = 1 AND rec_no >= 100").collect()}
    assert texts == {100: "reach me on [PHONE] about it", 101: "Reservation 4712007120 was confirmed", 103: None}
    assert pii.disclosed_spans(df.limit(0)).count() == 0


def names_of(spark, texts):
    df = spark.createDataFrame([("t", i, [t]) for i, t in enumerate(texts)], "tbl string, rec_no long, texts array<string>")
    return df, {r.rec_no for r in pii.disclosed_spans(df).filter("kind = 'person_name'").collect()}


def test_terms_disclose_names_anywhere(spark):
    texts = [f"My cousin Salma waits in room {i}" for i in range(8)] + ["the kettle of Salma broke", "Villa Salma was wet", "the kettle broke", "salma ko bol do", "We saw Brisbay at noon"]
    assert names_of(spark, texts)[1] == {*range(8), 8, 11}


def test_contexts_disclose_names(spark):
    """Nobody introduces Tomik; he stands where known names stand."""
    known = ["Salma", "Greta", "Kabir", "Noor"]
    texts = [f"My cousin {n} waits here" for n in known for _ in range(4)] + [f"Look for {n} beside the well" for n in known for _ in range(4)] + [f"Look for Tomik beside the well {i}" for i in range(3)]
    texts += ["Tomik fixed the lamp", "The lamp of Dorbay was wet"] + [f"We drove to Dorbay on day {i}" for i in range(4)]
    got = names_of(spark, texts)[1]
    assert {32, 33, 34, 35} <= got and not got & set(range(36, len(texts)))


def test_whole_names_are_redacted(spark):
    texts = ["Tell Greta Tonurst when you reach us", "My cousin Greta Ruthowitz broke it", "We saw Greta at Slate Road", "My name is Lena Ruthdrel and I wait", "We thank Lena on Monday", "mujhe chaabi lena hai", "Dena mat bhoolna", "We met Dr. A. Tonurst there"]
    df, _ = names_of(spark, texts)
    got = {r.rec_no: r.text for r in pii.redacted_turns(df).collect()}
    name = "[PERSON_NAME]"
    assert [got[i] for i in range(8)] == [f"Tell {name} when you reach us", f"My cousin {name} broke it", f"We saw {name} at Slate Road", f"My name is {name} and I wait", f"We thank {name} on Monday", *texts[5:7], f"We met {name} there"]


def test_redaction_keeps_the_rest():
    assert pii.redact("call 12345 or 6789 now", [(5, 10, "phone"), (14, 18, "phone")]) == "call [PHONE] or [PHONE] now"
    assert pii.redact("Salma Ruth here", [(0, 5, "person_name"), (6, 10, "person_name")]) == "[PERSON_NAME] here" and pii.redact(None, []) is None


# ---------------------------------------------------------------- 10

DOCS = {
    "list": "Packing list\n- 12 bowls\n- two chairs\n- a lamp\n- key\n* rug", "table": "place|nights|amount\nroof|3|879.45\njetty|6|526.79\nhall|4|",
    "junk": "njjrl gznl jrzlfcrcf rmndnzn ghkshc nvx xmm dgwxsj glk dnn", None: "We walked home.\nIt was late, and we slept.\nBring these:\n- soap",
}


def test_kinds_and_stats(spark):
    rows = [(i, DOCS[k], " EN_us ") for i, k in enumerate(DOCS)] + [(10, None, None), (11, "", "en"), (12, "one line only.", None)]
    rows += [(100 + i, "The cook was here and we went to the river with him.", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_key", F.lit("clash"))
    stats = quality.text_stats(df, "doc_id", "text", "lang")
    s = {r.doc_id: r for r in stats.collect()}
    assert s[0].lang_key == "en" and s[10].lang_key == "und" and s[11].n_words == 0 and s[10].mean_word_len is None
    assert s[12].n_words == 3 and s[12].end_punct_share == 1.0
    scored = quality.tail_scores(stats).cache()
    scores = quality.kind_scores(scored, quality.kind_weights(scored))
    assert {r.doc_id: r.kind for r in quality.kinds(scores).collect()} == {i: k for i, k in enumerate(DOCS) if k}
    assert all(quality.plainly(t) == k for k, t in DOCS.items()) and quality.plainly(" ") is None
    assert quality.kind_weights(quality.tail_scores(stats.limit(0))) is None


def test_scores_decide_not_the_definition(spark):
    """The weights come from labelled examples, the decision from ranks: a document just short of every threshold of the
    definition, but far out in its language, is still found; without its rank it is prose."""
    rows = [(i, "The cook was here and we went to the river with him.", "en") for i in range(300)] + [(1000 + i, DOCS["table"] + f"\nyard|{i}|2.50\n" * 3, "en") for i in range(20)]
    rows += [(2000 + i, DOCS["list"], "en") for i in range(20)] + [(3000 + i, DOCS["junk"], "en") for i in range(20)]
    rows += [(9000, "lamp|1|2.50\nroof|4|7.00", "en")]
    stats = quality.text_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    scored = quality.tail_scores(stats).cache()
    weights = quality.kind_weights(scored.filter("doc_id <> 9000"))
    got = {r.doc_id: r.kind for r in quality.kinds(quality.kind_scores(scored, weights)).collect()}
    assert quality.plainly(rows[-1][1]) is None and got[9000] == "table" and len(got) == 61
    flat = scored.withColumn("outlying", F.transform("outlying", lambda x: F.lit(0.0)))
    assert quality.kinds(quality.kind_scores(flat, weights)).count() == 0


def test_tails_are_exact_with_ties_over_partitions(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), float(rng.choice([0, 0, 0, 0, 0, 1, 2, rng.random()]))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, grp string, value double").withColumn("stat", F.lit("x"))
    got = {(r.grp, r.value): r.tail for r in quality.exact_tails(df.groupBy("stat", "grp", "value").agg(F.count("*").alias("n"))).collect()}
    for g in "ab":
        v = np.array([r[2] for r in rows if r[1] == g])
        for x in set(v):
            assert abs(got[g, x] - (v >= x).mean()) < 1e-12
    assert len(got) == len({r[1:] for r in rows})
    assert quality.exact_tails(df.limit(0).groupBy("stat", "grp", "value").agg(F.count("*").alias("n"))).count() == 0


def test_far_values_keep_their_ranks(spark, monkeypatch):
    """However far out a value is, its rank is its own; repeated ids stay separate rows, whether tails are broadcast or shuffled."""
    rows = [(i, "We walked to the river and it was late.", "en") for i in range(20)] + [(20 + i, "we saw " + "x" * (300 + 7 * i), "en") for i in range(20)]
    rows += [(100, "z" * n, "en") for n in (214, 215, 219, 220, 400, 400, 90000)]
    stats = quality.text_stats(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang").cache()
    tells = {"longest_word": quality.TELLS["longest_word"], "mean_word_len": quality.TELLS["mean_word_len"]}
    for few in (1000, 0):
        monkeypatch.setattr(quality, "FEW_GROUPS", few)
        # below this size Spark would broadcast unasked
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            got = quality.tail_scores(stats, tells).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        for at, (name, t) in enumerate(tells.items()):
            steps = np.array([max(0, int(r[name] // t.step) - int(t.ordinary // t.step)) for r in got])
            assert steps.max() > 10000
            assert all(abs(r.outlying[at] + np.log((steps >= v).mean())) < 1e-9 for r, v in zip(got, steps))


def test_small_languages_share_a_group(spark):
    df = spark.createDataFrame([(i, "en" if i < 30 else f"x{i % 4}") for i in range(40)], "doc_id long, lang_key string")
    assert {r.lang_key: r.grp for r in quality.grouped(df, 20).select("lang_key", "grp").distinct().collect()} == {"en": "en", "x0": "*", "x1": "*", "x2": "*", "x3": "*"}


# ---------------------------------------------------------------- 5


def test_network_learns_languages_from_dirty_labels(spark):
    rng = random.Random(2)
    words = {
        "en": "the cook was here and we went with him to old river while you kept this".split(),
        "es": "el cocinero estaba aquí y nosotros fuimos con él hasta viejo río mientras tú".split(),
        "de": "der Koch war hier und wir gingen mit ihm zum alten Fluss während du das".split(),
    }
    sent = lambda k: " ".join(rng.choices(words[k], k=12)) + "."
    rows = [(rng.choice(list(words)) if rng.random() < 0.1 else k, sent(k)) for k in words for _ in range(300)] + [(None, "x"), ("en", None)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string").withColumn("source", F.lit("t")), langid.Sample(400, 800, 6), ("en", "es", "de"))
    held = [(k, sent(k)) for k in words for _ in range(60)]
    got = model.languages([t for _, t in held])
    assert np.mean([g == k for (k, _), (g, _) in zip(held, got)]) > 0.97
    assert model.languages(["", "123 !!"]) == [(None, 0.0)] * 2
    # strings that no class was learned with make another language, with a low confidence
    assert all(k == "other" and c < 0.5 for k, c in model.languages(["Juru masak menyiapkan makan malam sementara kami menonton matahari", "Kucharz przygotowuje posiłek, zanim przyjdziemy znad jeziora"]))
    again = langid.ByteCNN.loads(model.dumps())
    assert again.languages([t for _, t in held]) == got
    df = spark.createDataFrame([(1, [f"{sent('en')}\n{sent('es')}", None]), (2, None)], "rec long, texts array<string>")
    assert [(r.seg_no, r.lang) for r in langid.segments(df, model, "line").orderBy("seg_no").collect()] == [(1, "en"), (2, "es")]


def test_models_are_fitted_once(spark, monkeypatch):
    rows = [("t", k, f"{k} word number {i} here") for k in ("en", "es") for i in range(40)]
    df = spark.createDataFrame(rows, "source string, lang string, text string")
    calls = []
    real = langid.fitted
    monkeypatch.setattr(langid, "fitted", lambda *a: calls.append(1) or real(*a))
    sample = langid.Sample(30, 30, 1, seed=random.randint(0, 1 << 30))
    first = langid.train(df, sample, ("en", "es"))
    langid._FITTED.clear()
    stored = langid.train(df, sample, ("en", "es"))
    assert len(calls) == 1 and all((first.p[k] == stored.p[k]).all() for k in first.p)


def test_record_language_rule(spark):
    rows = [(1, 1, 9, 9, "en", 0.9), (1, 2, 9, 9, "hi", 0.9), (2, 1, 9, 9, "hi", 0.9), (3, 1, 9, 9, "en", 0.9), (3, 2, 2, 1, "hinglish", 0.9), (4, 1, 2, 2, "hinglish", 0.9), (5, 1, 9, 9, "hinglish", 0.5)]
    df = spark.createDataFrame(rows, "rec long, seg_no int, n_words int, plain_words int, lang string, confidence double")
    assert {r.rec: r.lang for r in langid.record_language(df).collect()} == {1: "hinglish", 2: "hi", 3: "en", 4: "hinglish", 5: "hinglish"}


def test_document_language_weighs_lines(spark):
    rows = [(1, 1, 9, 9, "en", 0.9), (1, 2, 3, 3, "es", 0.8), (2, 1, 2, 0, "de", 0.5), (3, 1, 2, 0, None, 0.0), (4, 1, 9, 6, "en", 0.6), (4, 2, 9, 5, "hi", 0.9)]
    df = spark.createDataFrame(rows, "rec long, seg_no int, n_words int, plain_words int, lang string, confidence double")
    got = {r.rec: (r.lang, round(r.confidence, 4)) for r in langid.document_language(df).collect()}
    assert got == {1: ("en", 0.675), 2: ("de", 0.5), 4: ("hi", 0.4091)}


def test_languages_of_all_records_documents_and_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "_language_model", lambda spark, d: langid.ByteCNN(langid.LANGUAGES))
    turns = [["We came home. Aap kahan hain?", None, "12 34"], ["99 !!"], None, [""]]
    rows = [(i, [("guest", t) for t in ts] if ts is not None else None, (False, None)) for i, ts in enumerate(turns)]
    spark.createDataFrame(rows, "line_no long, turns array<struct<speaker: string, text: string>>, delivery struct<multiturn: boolean, language_mix: boolean>").write.parquet(str(tmp_path / "hinglish_spot_check.parquet"))
    docs = [(i, DOCS[k], "en") for i, k in enumerate(DOCS)] + [(10, None, "en"), (11, " \n", None), (12, "1|2\n3|4", "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    records = {r.line_no: r for r in queries.p5_records(spark, d).collect()}
    assert {k for k, r in records.items() if r.lang} == {0} and set(records) == {0, 1, 2, 3} and 0 < records[0].confidence <= 1
    documents = {r.doc_id: r for r in queries.p5_documents(spark, d).collect()}
    assert {k for k, r in documents.items() if r.lang and 0 < r.confidence <= 1} == {0, 1, 2, 3} and set(documents) == {0, 1, 2, 3, 10, 11, 12}
    segs = {(r.tbl, r.rec, r.seg_no): r.lang for r in queries.p5_segments(spark, d).collect()}
    want = {("hinglish_spot_check", 0, 1), ("hinglish_spot_check", 0, 2), ("hinglish_spot_check", 0, 3), ("hinglish_spot_check", 1, 1)}
    want |= {("documents", i, n) for i, t, _ in docs if t and t.strip() for n in range(1, len(t.split("\n")) + 1)}
    assert set(segs) == want and segs["hinglish_spot_check", 0, 1] and segs["hinglish_spot_check", 0, 3] is None and segs["documents", 12, 1] is None


# ---------------------------------------------------------------- 6


def test_defects(spark):
    ends = [f"Let us meet at the {w} before noon." for w in ("gate", "river", "hall", "roof")] * 3
    prompt = ["Please call me at 12 34 56 about the wet lamp in the hall, my cook is waiting.", None]
    options = [
        None, " … ", "Content filter: request declined.", "please CALL me at 12-34-56 about the wet lаmp in the hall; my cook is waiting!", "Nous avons beaucoup aimé la cour, mais le volet semblait bruyant.",
        "Let us meet at the gate be", "Let us meet at the river before noon", "Sorry, I cannot share my number here, but the cook reads this chat.", "email_link", "Let us meet because",
    ]
    rows = [(1, prompt, options, True), (2, prompt, None, True), (3, prompt, [], False), (4, None, ["Let us meet at the roof before noon."], None)] + [(10 + i, prompt, [e], True) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "rec long, texts array<string>, options array<string>, due boolean").withColumn("defect", F.lit("clash"))
    got = {(r.rec, r.option_no): r.defect for r in defects.defective(df).collect()}
    assert got == {(1, 1): "empty", (1, 2): "empty", (1, 3): "refusal", (1, 4): "copy", (1, 5): "language", (1, 6): "truncated", (1, 10): "truncated", (2, 0): "empty"}
    assert defects.defective(df.limit(0)).count() == 0


def test_refusals_in_either_language():
    yes = ["Main is text ko rewrite nahi de sakti, kuch aur likhiye.", "That request lies outside what I may do.", "Aisa message likhna mana hai.", "I refuse to rephrase it.", "Main iska jawab nahi likhunga."]
    no = ["Main apna number nahi de sakta, yahin likhiye.", "I cannot open the gate before noon.", "Nahi, kal milte hain.", "We will answer you in this chat."]
    assert all(map(defects.is_refusal, yes)) and not any(map(defects.is_refusal, no))


def test_copies_with_long_additions_and_english_under_hinglish(spark):
    prompt = ["Yaar gate ki chaabi kahan hai, main kal subah aapke ghar aa raha hoon aur mujhe pehle room dekhna hai."]
    options = ["Please ask the cook to bring the key before noon and reply in this thread.", "Chaabi ki baat yahin kar lete hain, kal tak hum aur main dekh lenge.", f"{prompt[0]} {prompt[0]}"]
    got = {r.option_no: r.defect for r in defects.defective(spark.createDataFrame([(1, prompt, options, True)], "rec long, texts array<string>, options array<string>, due boolean")).collect()}
    assert got == {1: "language", 3: "copy"}


def test_copies_of_a_truncated_option_do_not_vouch_for_it(spark):
    whole = [f"Let us meet at the {w} before noon." for w in ("gate", "river", "hall", "roof")]
    phrases = [f"The cook of the {w} says many thanks" for w in ("gate", "river", "hall", "roof")]
    rows = [(i, ["x y"], [t], True) for i, t in enumerate(whole + phrases)] + [(100 + i, ["x y"], ["Let us meet near the wet"], True) for i in range(40)]
    df = spark.createDataFrame(rows, "rec long, texts array<string>, options array<string>, due boolean")
    assert {(r.rec, r.defect) for r in defects.defective(df).collect()} == {(100 + i, "truncated") for i in range(40)}
