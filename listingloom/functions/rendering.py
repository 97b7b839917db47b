"""Texts shown to people: cards, pages of results, notifications, daily posts, and reasons in plain words."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from listingloom.functions.text import collapsed_text, redacted, safe_url

#: Words and line formats of the texts (fixed values).
UNKNOWN = "Noma'lum"
NOT_GIVEN = "ko'rsatilmagan"
NO_RESULTS = "Mos e'lon topilmadi. Filtrlarni o'zgartiring yoki reset qiling."
PAGE_RULE = "\n\n---\n\n"
RENOVATION = {"none": "ta'mirsiz", "basic": "oddiy ta'mir", "good": "yaxshi ta'mir", "euro": "euro ta'mir", "luxury": "premium ta'mir"}
STATUS_WORDS = {
    "success": "muvaffaqiyatli", "low_confidence": "ishonch darajasi past", "failed": "xatolik bilan tugadi",
    "high_confidence_duplicate": "aniq dublikat", "proceed_to_ai": "AI tekshiruviga yuborildi",
    "needs_reviewable_signal": "qo‘lda tekshiruv kerak", "manual_review": "qo‘lda tekshiruvga yuborildi",
    "auto_rejected": "avtomatik rad etildi", "online": "ishlayapti", "reconnecting": "qayta ulanmoqda",
    "flood_wait": "Telegram vaqtincha chekladi", "banned": "avtorizatsiya bloklangan", "missing": "topilmadi",
}
#: Code points of a card, of its description, of a page, and of a notification's description (fixed values).
CARD_CHARS, CARD_DESCRIPTION, PAGE_CHARS, NOTICE_DESCRIPTION = 900, 280, 3900, 220


def _line(label: str, value: Column) -> Column:
    """``label value``, or null where the value is null, so that the line is left out."""
    return F.concat(F.lit(label), value.cast("string"))


def _lines(*lines: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def _given(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(UNKNOWN))


def _renamed(value: Column, names: Mapping[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), value), otherwise)


def card_price(monthly: Column, currency: Column, basis: Column) -> Column:
    unit = F.when(basis == "per_person", "/kishiga").otherwise("/oy")
    return F.coalesce(F.trim(F.concat(monthly.cast("string"), F.lit(" "), F.coalesce(currency, F.lit("")), unit)), F.lit(UNKNOWN))


def card(listing: Column) -> Column:
    """A result card of a struct (monthly, currency, price_basis, price_period, district, rooms, renovation, source_count, has_media, source_url, description)."""
    description = F.nullif(F.substring(collapsed_text(F.coalesce(listing["description"], F.lit(""))), 1, CARD_DESCRIPTION), F.lit(""))
    text = _lines(
        _line("Narx: ", card_price(listing["monthly"], listing["currency"], listing["price_basis"])),
        _line("Davr/asos: ", F.concat_ws("/", listing["price_period"], listing["price_basis"])),
        _line("Tuman: ", _given(listing["district"])), _line("Xona: ", _given(listing["rooms"])), _line("Remont: ", _given(listing["renovation"])),
        _line("Manbalar: ", listing["source_count"]), _line("Rasm: ", F.when(listing["has_media"], "bor").otherwise("yoq")),
        _line("Link: ", F.nullif(listing["source_url"], F.lit(""))), description,
    )
    return F.substring(text, 1, CARD_CHARS)


def page(cards: Column) -> Column:
    """A page of results from an array of cards."""
    return F.when(F.size(cards) == 0, F.lit(NO_RESULTS)).otherwise(F.substring(F.array_join(cards, PAGE_RULE), 1, PAGE_CHARS))


def price_phrase(price: Column, currency: Column, period: Column, basis: Column) -> Column:
    """A price in a sentence: whole numbers without decimals, the period in front, sales and per-person prices marked."""
    number = F.when(price == F.floor(price), F.floor(price).cast("bigint").cast("string")).otherwise(price.cast("string"))
    amount = F.trim(F.concat(number, F.lit(" "), F.coalesce(currency, F.lit(""))))
    phrase = F.when(period == "daily", F.concat(F.lit("kuniga "), amount)).when(period == "one_time", F.concat(amount, F.lit(" (sotuv uchun)"))).otherwise(F.concat(F.lit("oyiga "), amount))
    return F.coalesce(F.concat(phrase, F.when(basis == "per_person", ", bir kishi uchun").otherwise("")), F.lit(NOT_GIVEN))


def notification(job: Column) -> Column:
    """The message of a struct (filter_name, price, currency, price_period, price_basis, district, rooms, area, renovation, furniture, address, description, source_count, source_url)."""
    whole = redacted(F.trim(F.coalesce(job["description"], F.lit(""))))
    short = F.when(F.length(whole) <= NOTICE_DESCRIPTION, whole).otherwise(F.concat(F.rtrim(F.substring(whole, 1, NOTICE_DESCRIPTION - 3)), F.lit("...")))
    filled = {n: F.nullif(job[n], F.lit("")) for n in ("district", "renovation", "address", "source_url")}
    return _lines(
        F.lit("Siz saqlagan filtringizga mos yangi e'lon topildi.\n"), _line("Filtr: ", F.coalesce(job["filter_name"], F.lit(""))),
        _line("Narxi: ", price_phrase(job["price"], job["currency"], job["price_period"], job["price_basis"])),
        _line("Joylashuvi: ", filled["district"]), F.concat(F.lit("Xonalar: "), job["rooms"].cast("string"), F.lit(" ta")),
        F.concat(F.lit("Maydoni: "), job["area"].cast("string"), F.lit(" m2")), _line("Ta'miri: ", _renamed(filled["renovation"], RENOVATION, filled["renovation"])),
        _line("Mebel: ", F.when(job["furniture"], "bor").when(~job["furniture"], "yo'q")), _line("Manzil: ", filled["address"]),
        _line("\nQisqacha: ", F.nullif(short, F.lit(""))),
        F.when(job["source_count"] > 1, F.concat(F.lit("Bu e'lon "), job["source_count"].cast("string"), F.lit(" ta kanalda uchradi."))),
        _line("Manba: ", filled["source_url"]),
    )


def whole_price(value: Column) -> Column:
    return F.bround(value.cast("decimal(38,4)"), 0).cast("bigint").cast("string")


def stats_post(day: Column, checked: Column, duplicates: Column, active: Column, average: Column, brand: str = "Listingloom") -> Column:
    """The daily statistics and the transparency report, under the name of the service."""
    mean = F.coalesce(F.concat(whole_price(average), F.lit(" USD")), F.lit("narx yetarli emas"))
    return _lines(
        F.lit(f"{brand} kunlik shaffoflik hisoboti"), _line("Sana: ", day), _line("Tekshirilgan e'lonlar: ", checked),
        _line("Dublikatlar: ", duplicates), _line("Faol e'lonlar: ", active), _line("O'rtacha oylik narx: ", mean),
    )


def district_post(day: Column, districts: Column) -> Column:
    """From an array of (district, n, average_price, least_price, greatest_price) in order; null if it is empty."""
    rows = F.transform(
        districts,
        lambda d: F.concat(
            d["district"], F.lit(": o'rtacha "), whole_price(d["average_price"]), F.lit(" USD ("), d["n"].cast("string"),
            F.lit(" ta, min "), whole_price(d["least_price"]), F.lit(", max "), whole_price(d["greatest_price"]), F.lit(")"),
        ),
    )
    head = F.array(F.lit("Tumanlar bo'yicha bozor narxi statistikasi"), _line("Sana: ", day), F.lit("Faqat active canonical, umumiy oylik ijara e'lonlari hisoblandi."))
    return F.when(F.size(districts) > 0, F.array_join(F.concat(head, rows), "\n"))


def offer_post(district: Column, rooms: Column, monthly: Column, currency: Column, source_url: Column) -> Column:
    price = F.coalesce(F.trim(F.concat(whole_price(monthly), F.lit(" "), F.coalesce(currency, F.lit("")))), F.lit("narx ko'rsatilmagan"))
    return _lines(
        F.lit("Bugungi konservativ top taklif"), _line("Tuman: ", F.coalesce(F.nullif(district, F.lit("")), F.lit("nomalum"))),
        _line("Xona: ", F.coalesce(rooms.cast("string"), F.lit("nomalum"))), _line("Oylik narx: ", price),
        F.lit("Ranking sababi: umumiy oylik narxi aniq, active canonical e'lonlar ichida arzon kandidat."),
        F.lit("Eslatma: bu kafolat yoki tavsiya emas; ma'lumotni manbadan tekshiring."), _line("Manba: ", F.when(F.coalesce(source_url, F.lit("")) != "", safe_url(source_url))),
    )


def reason_field(reason: Column, key: str, otherwise: str = "noma'lum") -> Column:
    """The value of ``key=value`` in a reason."""
    return F.coalesce(F.nullif(F.regexp_extract(reason, rf"\b{key}=([^\s]+)", 1), F.lit("")), F.lit(otherwise))


def status_words(status: Column) -> Column:
    return _renamed(status, STATUS_WORDS, F.replace(status, F.lit("_"), F.lit(" ")))


def plain_reason(reason: Column) -> Column:
    """An internal event code in words for operators; the formats are fixed values, unknown codes pass with = and _ spelt out."""

    def said(*parts: str | Column) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

    def told(key: str, otherwise: str = "noma'lum") -> Column:
        return reason_field(reason, key, otherwise)

    def unless(value: Column, none: str, *parts: str | Column) -> Column:
        return F.when(value == none, "").otherwise(said(*parts))

    account = F.coalesce(F.nullif(F.get(F.split(reason, r"\s+"), F.lit(2)), F.lit("")), F.lit("noma’lum"))
    listener = (
        F.when(reason.contains("hit FloodWait"), said("Telegram listener ", account, " vaqtincha cheklovga tushdi. Taxminiy kutish vaqti: ", F.trim(F.regexp_extract(reason, "^.*for(.*)$", 1)), "."))
        .when(reason.contains("authorization failed"), said("Telegram listener ", account, " avtorizatsiyadan o‘ta olmadi. Hisobni tekshiring."))
        .when(reason.contains("connection failed"), said("Telegram listener ", account, " Telegram bilan ulanishni yo‘qotdi va qayta ulanmoqda."))
        .when(reason.contains("no recent successful events"), said("Telegram listener ", account, " dan yaqinda muvaffaqiyatli xabar kelmadi."))
        .when(reason.contains("health changed to"), said("Telegram listener ", account, " holati o‘zgardi: ", status_words(F.trim(F.regexp_extract(reason, "^.*health changed to(.*)$", 1))), "."))
        .when(reason.contains("will be reassigned"), said(account, " listener ishlamayapti. Kanal boshqa listener'ga biriktiriladi."))
    )
    words = {
        "llm_attempt ": said(
            "AI modeli ", told("model"), " ", status_words(told("status")), " javob berdi.", unless(told("stage"), "noma'lum", " Zaxira bosqichi: ", told("stage"), "."),
            unless(told("latency_ms"), "noma'lum", " Javob vaqti: ", told("latency_ms"), " ms."), unless(told("error_type", "none"), "none", " Xatolik turi: ", told("error_type", "none"), "."),
        ),
        "pre_ai_dedup ": said(
            "Telegram xabari dublikat tekshiruvdan o‘tdi. Qaror: ", status_words(told("decision")), ". Manba: ", told("source"), ". Moslik belgilar soni: ", told("signal_count"), "."
        ),
        "ai_processing succeeded ": said("E’lon AI tomonidan muvaffaqiyatli qayta ishlandi. Manba: ", told("source"), ". Saqlangan rasmlar soni: ", told("media_count", "0"), "."),
        "ai_processing auto_rejected ": said("E’lon avtomatik rad etildi. Manba: ", told("source"), ". Sabab: ", status_words(told("reason")), "."),
        "ai_processing manual_review ": said("E’lon qo‘lda tekshiruvga yuborildi. Manba: ", told("source"), ". Sabab: ", status_words(told("reason")), "."),
        "ai_processing storage_failure ": said(
            "E’lon rasmlarini storage'ga saqlashda muammo yuz berdi. Manba: ", told("source"), ". Keyingi harakat: ",
            F.when(told("retryable") == "True", "qayta uriniladi").otherwise("qo‘lda tekshirish kerak"), ".",
        ),
        "ai_processing failed ": said("E’lonni AI qayta ishlay olmadi. Manba: ", told("source"), ". Barcha AI modellari ishlamagan yoki xatolik qaytargan."),
        "notification delivery bulk failure": said("Bir nechta foydalanuvchiga notification yuborilmadi. Muammoli yuborishlar soni: ", told("count", "noma’lum"), "."),
        "notification filter match failed": said(
            "Saqlangan filtrlarni e’lonlar bilan solishtirishda xatolik yuz berdi. Xatolik turi: ", F.trim(F.element_at(F.split(reason, ":"), -1)), "."
        ),
        "Telegram listener reload skipped": said("Telegram listenerlarni yangilashda ayrim manbalar o‘tkazib yuborildi. Admin panelni tekshiring."),
    }
    out = F.when(reason.startswith("Listener account ") & listener.isNotNull(), listener)
    for start, text in words.items():
        out = out.when(reason.startswith(start), text)
    return out.otherwise(said("Tizim xabari: ", F.replace(F.replace(reason, F.lit("_"), F.lit(" ")), F.lit("="), F.lit(": "))))
