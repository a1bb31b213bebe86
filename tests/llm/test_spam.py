"""Stuffed pages: languages that no list names, phrases of any length, hidden spelling, words of a corpus."""

import pytest

from pedlake.llm import spam

PROSE = {
    "it": "Ho provato a importare il file della famiglia ma il programma si ferma dopo pochi minuti senza dare alcun messaggio. Qualcuno sa come posso risolvere il problema, oppure devo aspettare la prossima versione?",
    "nl": "Ik probeer het bestand met de stamboom te laden, maar het programma stopt na een paar minuten zonder melding. Weet iemand hoe ik dit kan oplossen, of moet ik wachten op de volgende versie?",
    "pl": "Próbuję wczytać plik z drzewem rodzinnym, ale program zatrzymuje się po kilku minutach bez żadnego komunikatu. Czy ktoś wie, jak rozwiązać ten problem, czy muszę czekać na następną wersję?",
    "tr": "Soy ağacı dosyasını yüklemeye çalışıyorum ama program birkaç dakika sonra hiçbir ileti vermeden duruyor. Bu sorunu nasıl çözebileceğimi bilen var mı, yoksa bir sonraki sürümü mü beklemeliyim?",
    "ko": "가계도 파일을 불러오려고 하는데 몇 분 뒤에 아무 메시지도 없이 프로그램이 멈춥니다. 이 문제를 어떻게 해결할 수 있는지 아시는 분이 계신가요, 아니면 다음 버전을 기다려야 하나요?",
    "ar": "أحاول تحميل ملف شجرة العائلة لكن البرنامج يتوقف بعد بضع دقائق دون أي رسالة. هل يعرف أحد كيف يمكنني حل هذه المشكلة، أم يجب أن أنتظر الإصدار القادم؟",
    "sv": "Jag försöker läsa in filen med släktträdet men programmet stannar efter några minuter utan något meddelande. Vet någon hur jag kan lösa problemet, eller måste jag vänta på nästa version?",
    "zh": "我想把家谱文件导入程序，但是运行几分钟之后就停了，也没有任何提示。有没有人知道怎么解决这个问题，还是说我必须等下一个版本？文件不大，只有几百行，昨天还可以正常打开。",
    "hi": "मैं परिवार वृक्ष की फ़ाइल लोड करने की कोशिश कर रहा हूँ लेकिन कुछ मिनट बाद कार्यक्रम बिना किसी संदेश के रुक जाता है। क्या कोई जानता है कि इस समस्या को कैसे हल करें, या मुझे अगले संस्करण की प्रतीक्षा करनी होगी?",
    "fi": "Yritän ladata sukupuun tiedostoa, mutta ohjelma pysähtyy muutaman minuutin kuluttua ilman mitään ilmoitusta. Tietääkö kukaan, miten voin ratkaista tämän ongelman, vai pitääkö minun odottaa seuraavaa versiota?",
}
LISTS = {
    "it": "test del dna, kit saliva, albero genealogico, origini familiari, test paternità, kit offerta, dna economico, sconto kit, analisi geni, comprare kit, cromosomi, antenati online, parentela rapida, geni poster",
    "tr": "dna testi, ucuz kit, tükürük kutusu, soy ağacı, aile kökeni, gen raporu, indirim kutusu, babalık testi, hızlı kargo, ata haritası, kromozom afişi, akraba bulma, genom yazılımı, kalıtım kutusu",
    "zh": "基因检测，唾液盒，家谱软件，亲子鉴定，祖先地图，基因报告，优惠套装，遗传海报，血缘测试，快速发货，染色体图，低价试剂，官方正品，在线购买，家族起源，单倍型",
    "ko": "유전자 검사 최저가 유전자 검사 무료배송 유전자 검사 할인 유전자 검사 추천 유전자 검사 구매 유전자 검사 후기 유전자 검사 최저가 유전자 검사 세일",
}


@pytest.mark.parametrize("lang", PROSE)
def test_prose_of_a_language_the_corpus_lacks_is_no_list(lang):
    assert spam.score(PROSE[lang])[0] < 0.2


@pytest.mark.parametrize("lang", LISTS)
def test_lists_in_any_language(lang):
    assert spam.score_all([LISTS[lang]])[0][2]


def test_a_long_phrase_that_returns_is_seen_by_its_lag():
    phrase = "after a winter our neighbours bring fresh bread from the old mill near the river and sell it under blue tents every morning early "
    assert len(phrase.split()) == 24
    assert spam.score(phrase * 20)[0] > 0.9
    assert spam.score(phrase * 2)[0] < 0.1


def test_periods_do_not_reach_into_the_next_text():
    loop = "gene kit order now best price " * 60
    alone = [spam.score(t) for t in PROSE.values()]
    mixed = spam.score_all([x for t in PROSE.values() for x in (loop, t)])
    assert [m[:2] for m in mixed[1::2]] == alone and all(m[2] for m in mixed[::2])


def test_digits_for_letters():
    assert spam.score_all(["b3$t g3n3 k1t 0nl1n3 ch34p g3n3 k1t g3n3 k1t r3v13w 0rd3r g3n3 k1t $4l3 g3n3 k1t t0p g3n3 k1t"])[0][2]
    for names in ("BRCA1 TP53 MLH1 PALB2 CHEK2 CDH1 STK11 RAD51C RAD51D BARD1", "rs123 rs4567 rs89 chr1 chr2 p53 h2o co2 mp3 b12 " * 2):
        assert spam.score(names)[0] < 0.5


def test_few_links_and_tags():
    one = [spam.score_all([t])[0][2] for t in ("https://a.example/x\nhttps://b.example/y\nhttps://c.example/z", "https://a.example/x and https://b.example/y", "#dna #kit #gene #test #box #saliva #tree #map", "#dna #kit", "Thanks, see https://a.example/x and https://b.example/y, it is all explained there.")]
    assert one == [True, False, True, False, False]


def test_words_of_a_corpus(spark):
    nouns = ["table", "file", "matrix", "index", "panel", "marker", "trio", "score"]
    prose = [f"I have looked at the {a} of that {b}, but it is not what we want because the {a} was empty." for a in nouns for b in nouns]
    lists = [", ".join(f"{a} {b}" for b in nouns) + f", {a} sale" for a in nouns] * 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*prose, *lists, None, ""])], "doc_id long, text string")
    words = spam.corpus_words(df)
    assert {"the", "of", "that", "it", "is", "not", "because", "we"} <= words.sentence
    assert not words.sentence & set(nouns) and set(nouns) <= words.known
    no_marks = "table file matrix index panel marker trio score file table panel matrix marker index score trio table panel"
    assert spam.score(no_marks, words)[0] > 0.9
    got = {r["doc_id"] for r in spam.stuffed(df).where("stuffed").collect()}
    assert got == set(range(len(prose), len(prose) + len(lists)))
