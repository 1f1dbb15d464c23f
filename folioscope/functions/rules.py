"""Rule ladders that class, score and reject documents. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequent words by which Turkish and English texts are told apart.
TURKISH_WORDS = ("ve", "bir", "bu", "ile", "için", "olarak", "çalışma", "araştırma", "sonuç", "amaç", "yöntem")
ENGLISH_WORDS = ("the", "and", "of", "to", "in", "is", "for", "this", "study", "results", "method")
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
GLYPH_NAME = r"/[A-Za-z]{1,4}[0-9]+"

#: Fixed values: (field, category, pattern looked for in a free-text reason, case ignored).
REASON_RULES = (
    ("yazarlar", "Sira farki (ayni kisiler, farkli sira)", "SIRA"),
    ("yazarlar", "DB'de isim yanlis/eksik (gercek icerik hatasi)", "YANLIS SOYAD|EKSIK SOYAD|soyadsiz|fazladan soyad|EKSIK ve sira|DB'de YOK"),
    ("yazarlar", "Yazar kapak metninde hic gecmiyor", "HIC gecmiyor"),
    ("yazarlar", "Sadece diakritik farki", "yazar sadece diakritik|diakritik farki"),
    ("yazarlar", "Sadece buyuk/kucuk harf farki", "yazar sadece buyuk"),
    ("yazarlar", "Yazar kisi degil (kurul/kurum)", "kisi degil"),
    ("kelimeler", "DB bos, makalede VAR (referans eksik)", "kelime: DB bos, makalede (var|hem)"),
    ("kelimeler", "Indeksleyici kendi terimlerini yazmis", "indeksleyici|TAMAMEN FARKLI|FARKLI terimler|FAZLADAN terim"),
    ("kelimeler", "Sira farki", "kelime: ayni.*(sira|SIRA)"),
    ("kelimeler", "Makale anahtar kelime basmiyor", "anahtar kelime basmiyor|makalede de yok"),
    ("kelimeler", "Sadece buyuk/kucuk harf veya ayrac farki", "kelime sadece buyuk|ayrac farkli"),
    ("baslik", "DB kaydinda bicim hatasi (bosluk eksik/fazla)", "BOSLUK EKSIK|BOSLUK"),
    ("baslik", "DB Turkce, kapakta sadece Ingilizce", "baslik: DB'de Turkce"),
    ("ozet", "Zorlu PDF / bozuk font", "ZORLU PDF|BOZUK FONT"),
)


def _or(words: tuple[str, ...]) -> str:
    return "|".join(words)


def first_of(*options: tuple[Column, str], otherwise: Column | str | None = None) -> Column:
    """The name of the first condition that holds."""
    c = None
    for condition, name in options:
        c = F.when(condition, name) if c is None else c.when(condition, name)
    return c.otherwise(otherwise)


def all_of(*options: tuple[Column, str | Column]) -> Column:
    """The names of all conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in options]))


def number(c: Column, default: float | None = 0.0) -> Column:
    """A text as a number; the default where it is empty, None, or no number."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def word_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How often one of the words occurs, case ignored. Borders are borders of letters, digits and underscore."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{_or(words)})(?![\p{{L}}\p{{N}}_])"))


def vote(tr: Column, en: Column) -> Column:
    return first_of((tr > en * 1.3, "tr"), (en > tr * 1.3, "en"), otherwise="mix")


def language_vote(text: Column) -> Column:
    return vote(word_hits(text, TURKISH_WORDS), word_hits(text, ENGLISH_WORDS))


def letter_share(text: Column) -> Column:
    """Letters of all characters that are no space, in percent."""
    inked = F.length(F.regexp_replace(text, r"\s", ""))
    return F.length(F.regexp_replace(text, r"[^\p{L}]", "")) * 100.0 / F.greatest(inked, F.lit(1))


def glyph_share(text: Column) -> Column:
    """Share of characters in glyph names such as /g12."""
    return (F.length(text) - F.length(F.regexp_replace(text, GLYPH_NAME, ""))) / F.greatest(F.length(text), F.lit(1))


def text_layer(text: Column) -> Column:
    """No text, broken encoding, partly broken, sound."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    glyphs = glyph_share(text)
    return first_of((F.length(F.trim(text)) < 100, "metinsiz"), ((glyphs >= 0.30) | (letters < 0.45), "bozuk_kodlama"), (glyphs >= 0.03, "kismen_bozuk"), otherwise="saglam")


#: Where a label and the measured text layer contradict each other.
LAYER_HINTS = {
    "empty": "gercekten metinsiz -> taranmis/OCR sinifi",
    "not-scanned": "taranmis DEGIL: metin katmani var ama kodlamasi bozuk -> bozuk-font",
    "not-clean": "temiz DEGIL: kodlamasi bozuk -> bozuk-font (kolay katmandan cikarilmali)",
    "add-flag": "kodlama bozuk -> FLAGS'e bozuk-font eklenmeli",
    "partly": "kismi glif bozulmasi (govdede); baslik etkilenmiyorsa kolay kalabilir",
}


def layer_hint(primary: Column, layer: Column) -> Column:
    """What a contradiction between a label and the measured text layer suggests; empty without one."""
    hint = LAYER_HINTS
    broken = F.when(primary == "taranmis", hint["not-scanned"]).when(primary == "temiz-tr-taze", hint["not-clean"]).when(primary != "bozuk-font", hint["add-flag"])
    empty = F.when(~primary.isin("grobid-crash", "taranmis"), hint["empty"])
    partly = F.when(primary == "temiz-tr-taze", hint["partly"])
    return F.coalesce(F.when(layer == "metinsiz", empty).when(layer == "bozuk_kodlama", broken).when(layer == "kismen_bozuk", partly), F.lit(""))


def severity(chars: Column, letters: Column, replaced: Column, anomalies: Column, body: Column, title: Column, abstract: Column, authors: Column, crash: Column, flags: Column) -> Column:
    """Trouble score from 0 to 100. A missing title or author measure adds nothing, a missing abstract ten."""
    scanned = ((chars != 0) & (chars < 120)) | (letters < 8)
    s = F.when(scanned, 45.0).when(letters < 45, 32.0).when(letters < 60, 10.0).otherwise(0.0)
    s += F.when(crash & ~scanned, 28.0).otherwise(0.0)
    detail = F.coalesce((1 - title) * 22, F.lit(0.0))
    detail += F.when(abstract.isNull(), 10.0).when(abstract < 0.45, (1 - abstract) * 12).otherwise(0.0)
    detail += F.coalesce((1 - authors) * 10, F.lit(0.0))
    detail += F.when((body != 0) & (body < 500), 14.0).otherwise(0.0)
    detail += F.least(anomalies, F.lit(15.0)) + F.least(replaced * 1.5, F.lit(10.0))
    s += F.when(~scanned & ~crash, detail).otherwise(0.0)
    kinds = F.size(F.array_distinct(F.filter(flags, lambda x: (x != "") & (x != "temiz"))))
    s += F.greatest(F.lit(0), kinds - 1) * 4
    return F.least(F.lit(100), F.bround(s).cast("int"))


def severity_band(score: Column) -> Column:
    return first_of((score < 20, "hafif"), (score <= 50, "orta"), otherwise="agir")


def reject_reason(ok: Column, lang: Column, chars: Column, letters: Column, pages: Column, replaced: Column, body: Column, title: Column) -> Column:
    """The first rule that rules a document out of the easy pool; null if none does."""
    return first_of(
        (~ok, "grobid-calismadi"),
        (lang == "en", "ingilizce"),
        ((chars < 400) | (letters < 55), "taranmis"),
        (~pages.between(5, 28), "sayfa-araligi"),
        (replaced > 4, "karakter-bozuk"),
        (body < 1500, "govde-kisa"),
        (title < 0.4, "baslik-cok-yanlis"),
    )


def reject_reasons(chars: Column, letters: Column, pages: Column, tr_letters: Column, lang: Column, replaced: Column, ok: Column, title: Column, abstract: Column, authors: Column, body: Column) -> Column:
    """All rules that a clean document fails."""
    return all_of(
        ((chars < 400) | (letters < 55), "taranmis/dusuk-metin"),
        (~pages.between(4, 30), F.concat(F.lit("sayfa="), pages.cast("string"))),
        ((tr_letters < 30) | (lang == "en"), "turkce-degil"),
        (replaced > 4, "karakter-bozuk"),
        (~ok, "grobid-crash"),
        (title < 0.75, "baslik_sim"),
        (abstract.isNull(), "ozet-yok"),
        (abstract < 0.45, "ozet_sim"),
        (authors < 0.5, "yazar_rec"),
        (body < 1500, "govde-kisa"),
    )


def taxonomy(lang: Column, ok: Column, chars: Column, letters: Column, pages: Column, replaced: Column, title: Column, body: Column, abstract: Column, authors: Column) -> Column:
    """struct(primary, tier) of a hard candidate; null if the document is none."""
    scanned = ((chars < 200) | (letters < 20)) & pages.between(3, 60)
    primary = first_of(
        (lang == "en", F.lit(None)),
        (scanned & (letters < 8), "taranmis"),
        (scanned, "bozuk-font"),
        (~ok | ~pages.between(3, 40), F.lit(None)),
        ((chars < 120) | (letters < 8), "taranmis"),
        (letters < 45, "bozuk-font"),
        (replaced > 4, "karakter-anomali"),
        (title < 0.30, "header-title-yok"),
        (title < 0.72, "baslik-yanlis"),
        (body < 500, "govde-yok"),
        (abstract.isNull() | (abstract < 0.45), "ozet-eksik"),
        (authors < 0.5, "yazar-eksik"),
    )
    tier = F.when(primary.isin("baslik-yanlis", "ozet-eksik", "yazar-eksik"), "orta").when(primary.isNotNull(), "zor")
    return F.struct(primary.alias("primary"), tier.alias("tier"))


#: Marks of the kinds of software that make documents, the first that fits.
PRODUCERS = {
    "latex": "latex|pdftex|tex live|dvips|xetex|luatex",
    "indesign": "indesign|quark",
    "word": "word|libreoffice|openoffice|writer",
    "scan": "scan|abbyy|finereader|omnipage|paper capture",
}


def producer_class(producer: Column) -> Column:
    """The kind of software that made a document; bos if it names none."""
    p = F.lower(producer)
    return first_of(*[(p.rlike(pattern), kind) for kind, pattern in PRODUCERS.items()], (F.trim(p) != "", "other"), otherwise="bos")


def template_imitation(columns: Column, margin_top: Column, title_ratio: Column, title_center: Column, publisher_font: Column, kind: Column, generic_font: Column) -> Column:
    """A page laid out like a publisher's, made with office software and generic fonts."""
    geometry = (columns == 2) & (margin_top < 0.11) & (title_ratio < 1.8) & (title_center > 0.33) & (title_center < 0.67)
    return geometry & (publisher_font == 0) & kind.isin("word", "other", "bos") & (generic_font == 1)


def year_band(year: Column) -> Column:
    y = year.try_cast("int")
    return first_of((y <= 2012, "<=2012"), (y <= 2018, "2013-2018"), (y > 2018, "2019+"), otherwise="?")


def score_class(score: Column) -> Column:
    return first_of((score.isNull(), "none"), (score >= 70, "high"), (score >= 40, "medium"), otherwise="low")


def completeness(**fields: Column) -> Column:
    """Tam, or Eksik: with the names of the empty fields."""
    missing = all_of(*[(F.coalesce(F.trim(c), F.lit("")) == "", name) for name, c in fields.items()])
    return F.when(F.size(missing) == 0, "Tam").otherwise(F.concat(F.lit("Eksik:"), F.array_join(missing, "+")))


def first_filled(*columns: Column) -> Column:
    """The first value that is not empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def root_cause(text_chars: Column, output: Column, front: Column, title: Column, least_text: int = 50, least_output: int = 100) -> Column:
    """The first rung that explains a missing title: no text, no or hardly any output, no front part, a title that is empty."""
    return first_of(
        (text_chars < least_text, "no-text"),
        (output.isNull(), "no-output"),
        (F.length(F.trim(output)) < least_output, "short-output"),
        (~front, "no-front"),
        (F.trim(title) == "", "empty-title"),
        otherwise="other",
    )


def page_measures(pages: DataFrame, key: str, order: str, text: str, first: int = 3, least: int = 100) -> DataFrame:
    """key, pages and scanned: whether the first pages hold fewer than ``least`` characters on average."""
    count = pages.groupBy(key).agg(F.count(F.lit(1)).alias("pages"))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    front = pages.select(key, n.alias("_n"), F.coalesce(F.length(text), F.lit(0)).alias("_size")).filter(F.col("_n") <= first)  # limited on the map side
    mean = front.groupBy(F.col(key).alias("_key")).agg(F.avg("_size").alias("_mean"))
    return count.join(mean, F.col(key).eqNullSafe(F.col("_key"))).select(key, "pages", (F.col("_mean") < least).alias("scanned"))
