"""Where a question belongs and whether it may pass, as column expressions over its text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a question, and what shows its topic, a greeting, a follow-up, a reference to something said, an attempt at injection.
MAX_QUERY, MIN_WORDS = 500, 4
TOPIC = (
    r"(?i)\b(lalu ?lintas|traffic|emisi|emission|koridor|segmen|segment|seg|kor|halte|bus ?stop|"
    r"asi|avoid|shift|improve|intervensi|dashboard|volume|kendaraan|vkt|polusi|polutan|"
    r"pencemaran|kemacetan|macet|kecepatan|kepadatan|kapasitas|waktu\s*tempuh|transportasi|"
    r"parkir|rute|angkutan|moda|pejalan|sepeda|mobil|motor|bus|"
    r"co2|co\b|nox|so2|sox|pm|pm10|pm2\.?5|hc|"
    r"malioboro|jalan|jl|gang|gg|peta|wilayah|"
    r"aktivitas|activity|potensi|daerah|kawasan|zona|grid|sel|hex|ruas)\b"
)
GREETING = r"(?i)^\s*(halo|hai|hi|hello|pagi|siang|malam|selamat|terima\s*kasih|makasih|thanks)\b"
FOLLOW_UP = r"(?i)\b(kalau|kalo|yang|juga|kok|gimana|bagaimana|kenapa|mengapa|banding|bandingkan|dibanding|versus|vs|sama|rinci|detail|jelaskan|terangkan|lanjut|sebelumnya|tadi)\b"
SAID = r"(?i)\b(itu|ini|tersebut|tadi|sebelumnya|lain|lainnya|nya)\b"
INJECTION = (
    r"ignore\s+(all\s+)?(previous|above|prior|earlier)\s+(instructions?|prompts?|rules?)",
    r"abaikan\s+(semua\s+)?(instruksi|perintah|aturan)\s*(sebelumnya|di\s*atas)?",
    r"system\s+prompt",
    r"prompt\s+(sistem|awal)",
    r"reveal\s+(your\s+)?(system|hidden|initial|secret)",
    r"bocorkan\s+(system|prompt|instruksi)",
    r"\byou\s+are\s+(now|no longer)\b",
    r"\bkamu\s+(sekarang\s+)?adalah\b",
    r"<\s*script",
    r"base64",
    r"developer\s+mode",
)
# Words of questions by kind.
RANKING = r"(?i)\b(tersibuk|tertinggi|terbesar|terbanyak|terburuk|terbaik|terjelek|terbersih|paling\s+(sibuk|tinggi|besar|banyak|baik|buruk|jelek|bersih)|top|ranking|peringkat)\b"
OVERVIEW = (
    r"(?i)\b(koridor|jalan|segmen|segment)\s+(apa\s+saja|mana\s+saja|mana|semua|seluruh|daftar|list)\b"
    r"|\b(semua|seluruh|daftar|list)\s+(koridor|jalan|segmen|segment)\b"
    r"|\b(terendah|terkecil|tersedikit)\b|\bpaling\s+(rendah|kecil|sedikit)\b|\bnormal\b|\brata-rata\b"
)
# `THIS` does not count behind "apa " and "apakah ". As not every engine looks behind, what asks that way is taken out first.
ASKING_WHAT, THIS = r"(?i)\b(apa|apakah)\s(ini|itu|tersebut)\b", r"(?i)\b(ini|itu|tersebut)\b"
ACTIVITY = r"(?i)\b(potensi|aktivitas|activity)\b"
PLACE = r"(?i)\b(daerah|wilayah|kawasan|zona|area|lokasi|sel|grid|hex)\b|\bdi\s+mana\b"
ROAD = r"(?i)\b(koridor|jalan|segmen|segment|ruas)\b"
INTERVENTION = r"(?i)\b(intervensi|prioritas|asi|avoid|shift|improve|rekomendasi|saran|solusi|atasi|mengatasi|perbaiki|perbaikan|cakupan|halte|armada|frekuensi|strategi|langkah)\b"
WHY = r"(?i)^\s*(kenapa|mengapa|kok|gimana|bagaimana)\b"
ADVICE = r"(?i)\b(intervensi|prioritas|rekomendasi|rekomendasikan|saran|sarankan|solusi|strategi|langkah|atasi|mengatasi|perbaiki|perbaikan|asi|avoid|shift|improve)\b"
STOP = r"(?i)\b(halte|bus ?stop|terminal|shelter|trayek|pemberhentian)\b"
STOP_RANKING = r"(?i)\b(best|worst|terbaik|terburuk|terbagus|terjelek|paling\s+(baik|bagus|buruk|jelek)|tertinggi|terendah|terbesar|terkecil|ranking|peringkat)\b"
AREA = r"(?i)\b(grid|sel|hex|daerah|wilayah|kawasan|zona|area)\b"
# Words of evidence in a survey's description, by what they are evidence of.
EVIDENCE = {
    "facility": ("shelter", "halte", "bangku", "penerangan", "lampu", "rambu"),
    "pedestrian_access": ("trotoar", "menyeberang", "ramp", "akses", "parkir", "drainase"),
    "environment": ("bersih", "sampah", "vandalisme", "rusak", "nyaman", "lingkungan"),
    "user_activity": ("penumpang", "pengguna", "menunggu", "bus", "petugas"),
}


def about(project: str | None = None, assistant: str | None = None) -> tuple[str, ...]:
    """Patterns of questions about the project itself. Names of the project and of its assistant, as patterns, widen them."""
    things = "|".join([*([project] if project else []), "aplikasi", "dasbor", "dashboard", "proyek", "project", "webgis", "situs", "sistem"])
    who = "|".join(["kamu", "anda", *([assistant] if assistant else [])])
    return (
        rf"\b(apa itu|apakah itu|apa sih|what is|what's)\b.*\b({things})\b",
        *([rf"\b{project}\b"] if project else []),
        r"\b(apa bedanya|bedanya|beda|perbedaan|difference)\b.*\b(live|replay|real ?time|histori|historis|riwayat|mode)\b",
        r"\b(mode)\s+(live|replay)\b",
        r"\b(apa itu|apakah|what is|cara hitung|gimana cara|bagaimana cara|dari apa|terdiri dari|komponen|unsur)\b.*\b(skor|ranking|peringkat|potensi|aktivitas|activity|ahp)\b",
        r"\b(klasifikasi|kelas|tier|tingkatan)\b.*\b(potensi|aktivitas|ahp)\b",
        r"\b(apa itu|what is|cara hitung|gimana cara|bagaimana cara|dari mana|rumus|how)\b.*\b(emisi|emission|kg ?/ ?jam|gram per jam)\b",
        r"\b(data|datanya)\b.*\b(dari mana|dari|bersumber|sumber|source|asal)\b",
        r"\b(sumber|source)\b.*\b(data)\b",
        r"\b(data)\b.*\b(fresh|stale|basi|kadaluarsa|terbaru|update|perkiraan)\b",
        rf"\b({who})\b.*\b(bisa apa|bisa apa saja|kemampuan|capabilities|ngapain)\b",
    )


ABOUT = about()
#: White space at the ends of a text, and control characters that a history loses.
ENDS = r"^[\x09-\x0D\x1C-\x20\x85\p{Z}]+|[\x09-\x0D\x1C-\x20\x85\p{Z}]+$"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
MAX_TURNS, MAX_TURN = 10, 1000  # fixed values


def stripped(text: Column) -> Column:
    """Without white space of any alphabet at its ends."""
    return F.regexp_replace(text, ENDS, "")


def plain(text: Column) -> Column:
    """The text for patterns that know ASCII only: a letter or digit beyond it is `_`, which is part of a word and in none that is looked
    for; white space is a blank; anything else, as dashes, quotes and emoji, is `!`, which ends a word."""
    x = F.regexp_replace(F.regexp_replace(text, r"[\x85\p{Z}]", " "), r"[^\x00-\x7F\p{L}\p{N}]", "!")
    return F.regexp_replace(x, r"[^\x00-\x7F]", "_")


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found; a dot is anything but a line feed, as everywhere else."""
    return reduce(lambda a, b: a | b, [text.rlike(f"(?id){p}") for p in patterns])


def screened(text: Column, known: tuple[str, ...] = ABOUT) -> Column:
    """What becomes of a question: empty, too_long, injection and out_of_scope are turned away; pass, and no_scope_match, which is about
    the project itself (known: patterns of about()), are answered."""
    whole = stripped(F.coalesce(text, F.lit("")))
    x = plain(whole)
    fits = x.rlike(TOPIC) | x.rlike(GREETING) | (x.rlike(FOLLOW_UP) & x.rlike(SAID))
    short = F.size(F.regexp_extract_all(whole, F.lit("([a-zA-Z]+)"), 1)) < MIN_WORDS
    return (
        F.when(whole == "", "empty").when(F.length(whole) > MAX_QUERY, "too_long").when(any_of(x, INJECTION), "injection")
        .when(fits, "pass").when(any_of(x, known), "no_scope_match").when(short, "pass").otherwise("out_of_scope")
    )


def sanitized(text: Column) -> Column:
    """A turn of a history: no control characters, no attempts at injection, cut and then stripped."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    for p in INJECTION:
        x = F.regexp_replace(x, f"(?i){p}", "")
    return stripped(F.substring(x, 1, MAX_TURN))


def points_at(x: Column) -> Column:
    """Whether a question means what is selected ("this", "that"); x is a text of plain()."""
    return F.regexp_replace(x, ASKING_WHAT, "").rlike(THIS)


def dispatched(text: Column, stop: Column, cell: Column, segment: Column, named_stop: Column, named: Column, ambiguous: Column, crossing: Column) -> Column:
    """kind, target and resolved of a question, whose selection is stop, cell and segment (each null where nothing is selected).

    named_stop: the stop whose name the question holds; named: the segments that it means, as one text; ambiguous: whether its name fits
    several; crossing: the segments that cross the selected cell. What the question itself names is resolved; falling back to
    the selection, or to the overview, is not. A question that points at what isn't selected asks back.
    """
    x = plain(F.coalesce(text, F.lit("")))
    nothing = F.lit(None).cast("string")
    go = lambda kind, target=nothing, resolved=True: F.struct(F.lit(kind).alias("kind"), target.cast("string").alias("target"), F.lit(resolved).alias("resolved"))
    this, stops, roads, areas = points_at(x), x.rlike(STOP), x.rlike(ROAD), x.rlike(AREA)
    ranking = x.rlike(RANKING)
    activity = ~this & ~roads & x.rlike(ACTIVITY) & (x.rlike(PLACE) | ranking | F.lower(x).contains("potensi"))
    overview = ~this & (x.rlike(OVERVIEW) | ranking)
    ask = lambda what: go("clarify", F.lit(what))
    pointed = (
        F.when(stops, F.when(stop.isNotNull(), go("stop", stop)).otherwise(ask("stop")))
        .when(roads, F.when(segment.isNotNull(), go("segment", segment)).when(cell.isNotNull() & crossing.isNotNull(), go("segment", crossing)).otherwise(ask("segment")))
        .when(areas, F.when(cell.isNotNull(), go("hex", cell)).otherwise(ask("hex")))
        .when(cell.isNotNull(), go("hex", cell)).when(stop.isNotNull(), go("stop", stop)).when(segment.isNotNull(), go("segment", segment)).otherwise(ask("any"))
    )
    return (
        F.when(stops & x.rlike(STOP_RANKING), go("bus_stops"))
        .when(stops & stop.isNotNull() & (this | ~ranking), go("stop", stop))
        .when(stops & named_stop.isNotNull(), go("stop", named_stop))
        .when(activity, go("hex_activity")).when(overview, go("overview")).when(any_of(x, ABOUT), go("meta"))
        .when(this, pointed)
        .when(named.isNotNull(), go("segment", named)).when(F.coalesce(ambiguous, F.lit(False)), go("ambiguous"))
        .when(cell.isNotNull(), go("hex", cell, False)).when(stop.isNotNull(), go("stop", stop, False)).when(segment.isNotNull(), go("segment", segment, False))
        .otherwise(go("overview", resolved=False))
    )


def intent(text: Column) -> Column:
    """analysis for questions that want a recommendation; greeting; general."""
    x = plain(F.coalesce(text, F.lit("")))
    explains = x.rlike(WHY) & ~x.rlike(ADVICE)
    wants = x.rlike(INTERVENTION) & ~(x.rlike(STOP) & x.rlike(STOP_RANKING))
    return F.when(explains, "general").when(wants, "analysis").when(x.rlike(GREETING), "greeting").otherwise("general")


def history(turns: DataFrame, conversation: str, order: str) -> DataFrame:
    """The last MAX_TURNS turns (conversation, order, role, content) of each conversation that users and assistants said, sanitized; empty ones don't count."""
    said = turns.where(F.col("role").isin("user", "assistant")).select(conversation, order, "role", sanitized(F.col("text")).alias("content")).where("content <> ''")
    rank = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(order)))
    return said.withColumn("_rank", rank).where(F.col("_rank") <= MAX_TURNS).drop("_rank")
