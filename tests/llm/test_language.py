import pytest

from skeinwork.llm import language as lang

SENTENCES = {
    "en": ["The service stops without a message after the last release.", "We have also seen that the table reads the whole history.", "I think this step takes far too long during the night.", "Could you look at this again, because nobody had noticed it?", "There were many rows left when we stopped everything."],
    "de": ["Der Dienst bricht nach der letzten Auslieferung ohne Meldung ab.", "Wir haben auch gesehen, dass die Tabelle den ganzen Verlauf liest.", "Ich glaube, dieser Schritt braucht in der Nacht viel zu lange.", "Kannst du bitte noch einmal nachsehen, weil es niemand bemerkt hat?", "Es waren noch viele Zeilen übrig, als wir alles angehalten haben."],
    "nl": ["De dienst stopt zonder melding na de laatste uitrol.", "We hebben ook gezien dat de tabel de hele geschiedenis leest.", "Ik denk dat deze stap tijdens de nacht veel te lang duurt.", "Kun je hier nog eens naar kijken, omdat niemand het had gemerkt?", "Er waren nog veel regels over toen we alles stopten."],
    "fr": ["Le service s'arrête sans prévenir après la dernière mise en ligne.", "Nous avons aussi vu que la table relit tout l'historique.", "Je crois que cette étape prend beaucoup trop de temps pendant la nuit.", "Peux-tu regarder encore, parce que personne ne l'avait remarqué ?", "Il restait beaucoup de lignes quand nous avons tout arrêté."],
    "es": ["El servicio se detiene sin avisar después del último despliegue.", "También hemos visto que la tabla lee todo el historial.", "Creo que este paso tarda demasiado tiempo durante la noche.", "¿Puedes mirar otra vez, porque nadie se había dado cuenta?", "Quedaban muchas filas cuando lo paramos todo."],
    "pt": ["O serviço para sem avisar depois da última publicação.", "Também notamos que a tabela lê todo o histórico.", "Acho que esta etapa demora tempo demais durante a noite.", "Podes ver isto outra vez, porque ninguém tinha percebido?", "Ainda havia muitas linhas quando paramos tudo."],
    "it": ["Il servizio si ferma senza avvisare dopo l'ultimo rilascio.", "Abbiamo anche visto che la tabella legge tutta la cronologia.", "Credo che questo passaggio impieghi troppo tempo durante la notte.", "Puoi guardare di nuovo, perché nessuno se n'era accorto?", "Restavano molte righe quando abbiamo fermato tutto."],
    "pl": ["Usługa zatrzymuje się bez ostrzeżenia po ostatnim wdrożeniu.", "Zauważyliśmy też, że tabela czyta całą historię.", "Myślę, że ten krok trwa w nocy zbyt długo.", "Czy możesz sprawdzić jeszcze raz, bo nikt tego nie zauważył?", "Zostało jeszcze wiele wierszy, gdy wszystko zatrzymaliśmy."],
}


def judged(model, text):
    f = lang.scored([text], model)
    return lang.LANGUAGES[model.decide(f.sums.sum(0)[None] / f.n.sum() + model.offsets)[0][0]]


def parts_of(model, text):
    _, _, language, sure, start, end = lang.stretches([text], model)
    return [(lang.LANGUAGES[c], *x) for c, *x in zip(language.tolist(), sure.tolist(), start.tolist(), end.tolist(), strict=True)]


@pytest.fixture(scope="module")
def model():
    return lang.fit([(c, s) for c, ss in SENTENCES.items() for s in ss[:4]])


def test_held_out_sentences(model):
    """Four sentences a language teach; Spanish and Portuguese may still be taken for each other."""
    got = {c: judged(model, ss[4]) for c, ss in SENTENCES.items()}
    assert {c for c in SENTENCES if got[c] != c} <= {"es", "pt"} and {got["es"], got["pt"]} <= {"es", "pt"}


def test_held_out_samples():
    """Two thirds of the data's own labelled sentences teach, the rest is judged."""
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/lang_samples.parquet").to_pylist()
    fitted = lang.fit([(r["lang_code"], r["text"]) for r in t if r["sample_id"] % 3])
    held = [r for r in t if r["sample_id"] % 3 == 0]
    right = sum(judged(fitted, r["text"]) == r["lang_code"] for r in held)
    assert right / len(held) >= 0.95


def test_stretches_tags_code_and_short_parts(model):
    en, de = SENTENCES["en"], SENTENCES["de"]
    text = f"[user] {en[0]} {en[1]}\n```\nx = der die das und\n```\n{de[0]} OK. {de[1]}\n[assistant] {en[2]}"
    parts = parts_of(model, text)
    assert [p[0] for p in parts] == ["en", "de", "en"]
    assert all(0 < p[1] <= 1 for p in parts)
    assert text[parts[1][2] : parts[1][3]].strip().startswith("Der Dienst")
    assert parts_of(model, "") == [] and parts_of(model, "12 34 !!") == [] and parts_of(model, "```\ncode()\n```") == []


def test_texts_of_a_batch_do_not_mix(model):
    """Each text gets what it gets alone, even after an open code block, and whatever the chunks."""
    texts = [" ".join(SENTENCES["en"]), "", "```\nnever closed", SENTENCES["fr"][0], "12", "\x00" + SENTENCES["de"][0] + "\n" + SENTENCES["pl"][1], " ".join(SENTENCES["it"] * 40)]
    text, place, language, sure, start, end = lang.stretches(texts, model)
    for n, t in enumerate(texts):
        at = text == n
        assert [(lang.LANGUAGES[c], round(p, 6), a, b) for c, p, a, b in zip(language[at], sure[at], start[at], end[at], strict=True)] == [(c, round(p, 6), a, b) for c, p, a, b in parts_of(model, t)]
        assert place[at].tolist() == list(range(1, at.sum() + 1))


def test_what_is_no_language():
    assert lang.words("see src/main.py [user] load(12) foo_bar a.b v2 'quoted' (sagt) it's Session-Cache — 12%") == ["see", "quoted", "sagt", "it's", "session", "cache"]


def test_confidence_follows_the_labels(model):
    """Labels that agree with most decisions make a steep curve, labels drawn at random a flat one."""
    docs = [(c, s) for c, ss in SENTENCES.items() for s in ss] * 3
    assert lang.calibrated(model, docs) > lang.calibrated(model, [(lang.LANGUAGES[(n * 3) % 8], t) for n, (_, t) in enumerate(docs)])
    assert lang.calibrated(model, []) == model.slope


SCHEMA = "doc_id long, text string, lang string, label string, segments int"


def test_table(spark):
    samples = spark.createDataFrame([(c, s) for c, ss in SENTENCES.items() for s in ss] + [(None, "x"), ("en", None)], "lang_code string, text string")
    en, fr = " ".join(SENTENCES["en"]), " ".join(SENTENCES["fr"])
    docs = [(1, en, "en-GB"), (2, en, "German"), (3, en, None), (4, en, "und"), (5, en + "\n" + fr, "en"), (6, None, "en"), (7, "", "en"), (None, en, "fr"), (8, fr, "FRA"), (9, (en + "\n") * 200, "sv")]
    found = lang.classify(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA), samples)
    assert {(r["doc_id"], r["segment_no"], r["lang_code"]) for r in lang.mislabelled(found).collect()} == {(2, 1, "en"), (3, 1, "en"), (4, 1, "en"), (5, 1, "en"), (5, 2, "fr"), (9, 1, "en")}
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3, 4, 5, 8, 9}
    assert lang.classify(spark.createDataFrame([], SCHEMA), samples).count() == 0
    with pytest.raises(ValueError):
        lang.classify(spark.createDataFrame([], SCHEMA), samples.limit(0))
