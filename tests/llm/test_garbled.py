import random

import pytest

from factloom.llm import garbled

#: Sound sentences; the first half is for training, the others are held out.
SOUND = [
    "Die Prüfung läuft jetzt über alle Dateien, weil größere Verzeichnisse früher übergangen wurden.", "Der Schlüssel muss geändert werden, bevor die Übergabe beginnt; das genügt für heute.",
    "Le problème n’apparaît qu’à partir de cent fichiers, dès que la clé est chargée.", "Même résultat qu’auparavant, mais l’exécution dure deux fois moins longtemps à côté.",
    "La revisión número tres falló porque faltaba el método más pequeño de la clase.", "¿Se puede llamar dos veces? Sí, pero no desde la versión anterior.",
    "Atenção: a função só é criada depois da primeira execução, não há alteração.", "A INICIALIZAÇÃO NÃO É OBRIGATÓRIA, segundo o parâmetro da versão.",
    "Błąd występuje tylko wtedy, gdy klucz jest większy niż tysiąc wierszy.", "Ścieżka względna jest częścią klucza, należy najpierw usunąć obsługę.",
    "Ошибка возникает только при большом числе файлов, если ключ не найден.", "После последней загрузки осталось много устаревших записей в каталоге.",
    "クラスは鍵を保持し、関数に渡します。まず実行し、関数の数を比較してください。", "前回のアップロード後、古い項目が残っていました。変更には必ずテストを追加してください。",
    "It isn’t obvious why “slow” comes first – the spans differ by one line…", "The test takes 5 ms ± 1 ms at 70 °C, and it’s ≈ 12 handles after an hour.",
]
QUOTES = ["Test data: decode(b'\\xc3\\xbc') must not give Ã¼ (loadKey).", "The viewer prints â€™ instead of an apostrophe since then.", "The page shows Ã© where the source has é; nothing else is wrong."]


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    words = " ".join(SOUND[::2] + SOUND[1::2]).split()
    lines = SOUND + [" ".join(rnd.choices(words, k=6)) for _ in range(600)]
    return garbled.fit([x for x in lines if not x.isascii()])


def test_every_chain_inverts():
    for chain in garbled.CHAINS:
        for x in SOUND:
            if (g := garbled.garble(x, chain)) is not None:
                assert garbled.invert(g, chain) == x


def test_held_out_accuracy():
    train = [x for k, x in enumerate(SOUND) if k % 2 == 0]
    rnd = random.Random(2)
    words = " ".join(train).split()
    model = garbled.fit(train + [" ".join(rnd.choices(words, k=6)) for _ in range(600)])
    held = [x for k, x in enumerate(SOUND) if k % 2]
    main = ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp1251", "utf-8 as cp437", "utf-8 as cp850", "utf-8 as mac-roman", "utf-8 as cp1252 twice"]
    cases = [(x, g) for x in held for c in main if (g := garbled.garble(x, c))]
    got = garbled.judge([g for _, g in cases], model)
    found = sum(v.chain is not None for v in got)
    right = sum(v.text == x for v, (x, _) in zip(got, cases))
    assert found >= 0.97 * len(cases) and right >= 0.95 * len(cases)
    assert [v.chain for v in garbled.judge(held, model)].count(None) >= len(held) - 1


def test_sound_and_quoted_lines_stay(model):
    assert [v.chain for v in garbled.judge(SOUND + QUOTES, model)] == [None] * len(SOUND + QUOTES)


@pytest.mark.parametrize("chain", ["cp1251 as cp1252", "koi8-r as cp1252", "shift-jis as cp1252", "euc-jp as cp1252", "iso8859-2 as cp1252"])
def test_chains_between_other_encodings(model, chain):
    hits = [(x, g) for x in SOUND[8:14] if (g := garbled.garble(x, chain)) and not x.isascii()]
    got = garbled.judge([g for _, g in hits], model)
    assert hits and sum(v.text == x for v, (x, _) in zip(got, hits)) >= 0.8 * len(hits)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, chains string, h int")


def test_documents(spark, model):
    bad = garbled.garble(SOUND[0], "utf-8 as cp1252")
    texts = [None, "", "plain ascii", SOUND[2], f"# title\n{SOUND[2]}\n{bad}\r\n", "Die Pr��fung", QUOTES[0], bad * 2000, "﻿" + SOUND[3], "שלום 한국어 ﬁ ​"]
    got = {r["doc_id"]: r for r in garbled.restore(frame(spark, texts), model).collect()}
    assert set(got) == {4, 5, 7}
    assert got[4]["text"] == f"# title\n{SOUND[2]}\n{SOUND[0]}\r\n" and got[4]["n_lines"] == 1
    assert got[5]["text"] is None and got[5]["chains"] == ["lost"]
    assert got[7]["text"] == SOUND[0] * 2000


def test_no_break_space_that_became_a_blank(model):
    g = garbled.garble("Le problème n’apparaît qu’à partir de là, dès que c’est chargé à côté.", "utf-8 as cp1252").replace("\xa0", " ")
    assert garbled.judge([g], model)[0].text == "Le problème n’apparaît qu’à partir de là, dès que c’est chargé à côté."


@pytest.mark.parametrize("n", [20, 33, 400])
def test_any_number_of_no_break_spaces(model, n):
    """Р is D0 A0 in UTF-8, so every one of a run leaves a blank where the no-break space is lost."""
    x = "Ошибка " + "Р" * n + " найдена в каталоге"
    g = garbled.garble(x, "utf-8 as cp1252").replace("\xa0", " ")
    assert garbled.judge([g], model)[0].text == x


def sampled(*a):
    return [r[0] for r in garbled.sample(*a).collect()]


def test_short_lines_count_together(spark, model):
    words = ["größere", "Schlüssel", "läuft", "Übergabe", "genügt", "Prüfung", "geändert", "früher", "für", "Verzeichnisse über"]
    bad = [garbled.garble(f"{w} {k}", "cp1252 as mac-roman") for k, w in enumerate(words)]
    texts = ["\n".join(bad), "\n".join(words), "Ã¼", "x\n" + words[0], "a\xa0\xa0b\n\xa0\xa0\n\u2003"]
    got = {r["doc_id"]: r for r in garbled.restore(frame(spark, texts), model).collect()}
    assert set(got) - {2} == {0} and got[0]["text"] == "\n".join(f"{w} {k}" for k, w in enumerate(words))
    assert all(v.chain is None for v in garbled.judge(bad[:3], model))


def test_training_in_tasks_gives_the_same_model(spark):
    lines = spark.createDataFrame([(x,) for x in SOUND], "line string").repartition(3)
    a, b = garbled.fit_table(lines), garbled.fit(SOUND)
    assert a.names == b.names and (a.weights == b.weights).all()


def test_training_on_a_corpus(spark):
    assert garbled.restore(frame(spark, []), garbled.train(frame(spark, []))).count() == 0
    rows = frame(spark, [x for x in SOUND for _ in range(2)] + [garbled.garble(SOUND[0], "utf-8 as cp1252")])
    lines = sampled(rows, 5, 3)
    assert 0 < len(lines) <= 3 and lines == sampled(rows.repartition(3), 5, 3)
    assert {r["doc_id"] for r in garbled.restore(rows, garbled.train(rows)).collect()} == {len(SOUND) * 2}


def test_sample_of_a_larger_corpus_is_drawn_by_hash(spark):
    rows = frame(spark, [f"é {i}" for i in range(900)])
    lines = sampled(rows, 100, 1000)
    assert len(lines) == 100 and lines == sampled(rows.repartition(5), 100, 1000)
