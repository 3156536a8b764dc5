"""Scalar functions as Column builders: all stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch class names with flats as their sharps, and cover sizes.
PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def fold_bpm(bpm: Column) -> Column:
    """log2 of a tempo folded by octaves into [70, 140); null unless finite and positive."""
    usable = bpm.isNotNull() & ~F.isnan(bpm) & (bpm > 0) & (bpm < float("inf"))
    octave = F.floor(F.log2(bpm / 70.0))
    folded = bpm / F.pow(F.lit(2.0), octave)
    # The logarithm may fall a hair to the wrong side of a power of two.
    folded = F.when(folded < 70, folded * 2).when(folded >= 140, folded / 2).otherwise(folded)
    return F.when(usable, F.log2(folded))


def key_coordinates(key: Column, scale: Column, strength: Column) -> Column:
    """(fifths_cos, fifths_sin, mode) of a key on the circle of fifths, scaled by its strength (0.5 unless finite)."""
    place = F.array_position(F.array(*map(F.lit, PITCHES)), key) - 1
    angle = (place * 7 % 12) * (2 * 3.141592653589793 / 12)
    s = F.when(strength.isNull() | F.isnan(strength), 0.5).otherwise(strength)
    known = key.isNotNull() & (place >= 0)
    zero = F.lit(0.0)
    return F.struct(
        F.when(known, F.cos(angle) * s).otherwise(zero).alias("fifths_cos"),
        F.when(known, F.sin(angle) * s).otherwise(zero).alias("fifths_sin"),
        F.when(known, F.when(scale == "major", s).otherwise(-s)).otherwise(zero).alias("mode"),
    )


def release_year(date: Column) -> Column:
    """The first four characters as a number, if they are all digits."""
    return F.regexp_extract(date, r"\A([0-9]{4})", 1).try_cast("int")


def year_label(date: Column) -> Column:
    """The first four characters; the empty text if there are fewer."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4)).otherwise("")


def duration_label(seconds: Column) -> Column:
    """m:ss; blank if null or not positive."""
    whole = seconds.cast("long")
    return F.when(whole > 0, F.format_string("%d:%02d", F.floor(whole / 60), whole % 60)).otherwise("")


def full_title(title: Column, version: Column) -> Column:
    """`title (version)`; `Unknown Track` without a title."""
    return F.when(title.isNull() | (title == ""), "Unknown Track").when(version.isNotNull() & (version != ""), F.concat(title, F.lit(" ("), version, F.lit(")"))).otherwise(title)


def artist_title(artist: Column, title: Column) -> Column:
    """`Artist - Title`; the title alone without an artist."""
    return F.when(F.coalesce(artist, F.lit("")) == "", title).otherwise(F.concat(artist, F.lit(" - "), title))


def cover_path(album: Column) -> Column:
    """The last two and the two before them of an id's letters and digits, as folders; null under four."""
    clean = F.regexp_replace(album, "[^0-9A-Za-z]", "")
    n = F.length(clean)
    return F.when(n >= 4, F.concat_ws("/", F.substring(clean, -2, 2), F.substring(clean, n - 3, F.lit(2)), clean))


def recording(isrc: Column, track: Column) -> Column:
    """What two tracks of one recording share: the trimmed upper-case ISRC, or the track's own id."""
    return F.coalesce(F.nullif(F.upper(F.trim(isrc)), F.lit("")), F.concat(F.lit("id:"), track.cast("string")))


def json_number(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path).try_cast("double")


def slim_json(payload: Column, field: str) -> Column:
    """An object of one number alone; null for a null payload, and a null number kept."""
    return F.when(payload.isNotNull(), F.to_json(F.struct(json_number(payload, f"$.{field}").alias(field)), {"ignoreNullFields": "false"}))


def excerpt_start(seconds: Column, length: float = 90.0) -> Column:
    """Where an excerpt of the middle begins; 0 if the track is no longer, or of unknown length."""
    return F.when(seconds > length, (seconds - length) / 2).otherwise(0.0)


def split_credits(credits: Column) -> Column:
    return F.filter(F.transform(F.split(credits, ";"), lambda t: F.trim(t)), lambda t: t != "")


def moved_index(index: Column, start: Column, end: Column) -> Column:
    """Where the item at `index` is after the one at `start` moved to `end`."""
    return F.when(index == start, end).when((start < index) & (index <= end), index - 1).when((end <= index) & (index < start), index + 1).otherwise(index)


def all_terms(query: str, *fields: Column) -> Column:
    """Every white-space-separated term in one field at least, ignoring case."""
    out = F.lit(True)
    for term in query.lower().split():
        found = F.lit(False)
        for field in fields:
            found = found | F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lit(term))
        out = out & found
    return out


def starts_rank(query: str, *fields: Column) -> Column:
    """0 if a field starts with the first term, else 1."""
    terms = query.lower().split()
    if not terms:
        return F.lit(1)
    starts = F.lit(False)
    for field in fields:
        starts = starts | F.startswith(F.lower(F.coalesce(field, F.lit(""))), F.lit(terms[0]))
    return F.when(starts, 0).otherwise(1)


# --- payloads ------------------------------------------------------------


def _kind(payload: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(F.try_parse_json(payload), path, "variant"))


def number_id(payload: Column, path: str) -> Column:
    """A whole number, or a string of one; null for all else."""
    text = F.get_json_object(payload, path)
    return F.when(_kind(payload, path).isin("BIGINT", "STRING"), text.try_cast("long"))


def text_id(payload: Column, path: str) -> Column:
    """A number as text, or a string that isn't empty; null for all else."""
    return F.when(_kind(payload, path).isin("BIGINT", "STRING"), blank_to_null(F.get_json_object(payload, path)))


def blank_to_null(text: Column) -> Column:
    """Null for the empty text; white space stays."""
    return F.nullif(text, F.lit(""))


def first_artist(*ways: tuple[Column, Column]) -> Column:
    """(name, id) of the first way (name, id) with a name; `Unknown Artist` of no id without any."""
    out = F.struct(F.lit("Unknown Artist").alias("name"), F.lit(None).cast("long").alias("id"))
    for name, ident in reversed(ways):
        out = F.when(blank_to_null(name).isNotNull(), F.struct(name.alias("name"), ident.cast("long").alias("id"))).otherwise(out)
    return out


def first_known(*texts: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*map(blank_to_null, texts))


# Image sizes by preference, and where portraits are.
IMAGE_SIZES = ("small", "medium", "large", "thumbnail", "extralarge", "mega")
PORTRAITS = "https://static.qobuz.com/images/artists/covers/medium/"


def image(payload: Column, portraits: str = PORTRAITS) -> Column:
    """A payload's image: the text as it is, else of its sizes the first preferred one; else the portrait of its hash."""
    sizes = [F.get_json_object(payload, f"$.image.{s}") for s in IMAGE_SIZES]
    whole = F.when(_kind(payload, "$.image") == "STRING", F.get_json_object(payload, "$.image"))
    portrait = F.get_json_object(payload, "$.images.portrait.hash")
    return first_known(whole, *sizes, F.concat(F.lit(portraits), blank_to_null(portrait), F.lit(".jpg")))


def utc_text(time: Column) -> Column:
    """A time in UTC to the second, with its offset; sorts as text. The session's zone must be UTC."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def digest(content: Column) -> Column:
    """MD5 of bytes or text in lower-case hexadecimal, by which files are compared."""
    return F.md5(content)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def style_prompt(style: Column) -> Column:
    return F.concat(style, F.lit(" music"))


def byte_window(size: Column, seconds: Column, length: float = 90.0, slack: float = 3.0) -> Column:
    """(start, end) of the bytes that hold an excerpt from the middle; all of them if the duration isn't known."""
    rate = size / seconds
    start = F.floor(excerpt_start(seconds.cast("double"), length) * rate)
    known = seconds > 0
    return F.struct(
        F.when(known, F.least(start, size)).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(known, F.least(start + F.floor((length + slack) * rate), size)).otherwise(size).cast("long").alias("end"),
    )


def worth_keeping(query: str, artist: Column, title: Column, album: Column) -> Column:
    """A remote hit whose title has all terms, or whose match can't be placed in any field."""
    return all_terms(query, title) | ~all_terms(query, artist, title, album)
