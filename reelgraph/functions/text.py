"""Text expressions and parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of simple keywords.
STOP_WORDS = (
    "what", "which", "who", "where", "when", "why", "how",
    "does", "do", "did", "is", "are", "was", "were",
    "the", "a", "an", "of", "in", "on", "at", "to", "for",
    "and", "or", "but", "not", "this", "that", "these", "those",
    "option", "answer", "question", "following", "correct",
    "video", "clip", "frame", "scene",
    "based", "content", "whose", "viewpoint", "relatively", "according", "mainly", "about",
)
#: Words that mark kinds of questions.
FLAGS = {
    "not_correct": r"\b(not correct|incorrect|not true|false|is not)\b",
    "temporal": r"\b(first|last|before|after|then|earlier|later|beginning|end|start|finally|next|previous)\b",
    "count": r"\b(how many|number of|count|times)\b",
    "text": r"\b(text|title|word|name|label|subtitle|sign|caption|written|letter|logo|year|date)\b",
    "audio": r"\b(hear|said|says|narrator|voice|sound|music|audio|spoken|speak)\b",
}
#: Phrases that turn the criterion of an answer round, wherever they stand.
REVERSED = ("not correct", "incorrect", "not true", "false", "is not")
#: Words so common in descriptions of pictures that their frequency starts at SEED.
SEEN_OFTEN = (
    "video", "clip", "scene", "frame", "screen", "visual", "show", "showing",
    "image", "picture", "footage", "camera", "shot", "view", "angle",
    "person", "people", "man", "woman", "guy", "girl", "someone",
    "background", "foreground", "left", "right", "center", "top", "bottom",
)
SEED = 100
#: Parts of messages after which a call is worth another attempt.
TRANSIENT = (
    "unable to reach the model provider", "error_openai", "connection error", "connect", "timed out", "timeout",
    "temporarily unavailable", "service unavailable", "bad gateway", "gateway timeout", "502", "503", "504",
)
#: Line ends as str.splitlines() knows them.
LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used, also inside lambdas: what a lambda takes from outside
    is otherwise made anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trimmed(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def reversed_question(q: Column) -> Column:
    """Whether the incorrect option is asked for, by phrases anywhere in the text."""
    return F.coalesce(F.exists(F.array(*map(F.lit, REVERSED)), lambda w: F.contains(F.lower(q), w)), F.lit(False))


def question_flags(q: Column) -> dict[str, Column]:
    return {k: F.coalesce(F.lower(q).rlike(p), F.lit(False)) for k, p in FLAGS.items()}


def tokens(text: Column) -> Column:
    """Lower case, "text:" dropped, runs of a-z0-9; longer than one or a digit."""
    flat = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("text:"), F.lit(" ")), "[^a-z0-9]+", " "))
    return F.filter(F.split(flat, " "), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$"))


def clean_keywords(k: Column) -> Column:
    """Trimmed, without blanks, the first of each."""
    return F.array_distinct(F.filter(F.transform(k, lambda x: F.trim(x)), lambda x: x != ""))


def visual_keywords(k: Column) -> Column:
    return F.filter(clean_keywords(k), lambda x: ~F.lower(x).startswith("text:"))


def simple_keywords(q: Column, most: int = 5) -> Column:
    """The first words of over two letters that are no stop words, without punctuation around them."""
    edge = r"""^[.,?!;:'"()\[\]]+|[.,?!;:'"()\[\]]+$"""
    words = F.transform(F.split(F.lower(q), r"\s+"), lambda w: F.regexp_replace(w, edge, ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))), 1, most)


def pieces(text: Column, words: int = 50) -> Column:
    """Consecutive pieces of so many words."""
    def cut(w):
        n = F.ceil(F.size(w) / F.lit(words)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * words + 1, F.lit(words)), " "))).otherwise(F.array().cast("array<string>"))

    return let(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""), cut)


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u4e00-\\u9fff]")


def listed_options(q: Column) -> Column:
    """The strings of a bracketed list after Options:, as Python writes it; none if it can't be read as one."""
    part = F.regexp_extract(q, r"(?s)(\[.*\])", 1)
    item = r"""'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*\""""
    fits = F.contains(q, F.lit("Options:")) & part.rlike(rf"(?s)^\[\s*(?:(?:{item}|-?\d+(?:\.\d*)?|None|True|False)\s*(?:,\s*|(?=\])))*\]$")
    plain = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"\\(['\"\\])", "$1")
    return F.when(fits, F.transform(F.regexp_extract_all(part, F.lit(f"({item})"), 1), plain)).otherwise(F.array().cast("array<string>"))


def option_letters(q: Column) -> Column:
    """Letters of the options that a question lists, sorted: of items like A. x in a bracketed list, and of lines like
    A. x, B) x or (C) x, where white space must follow the mark."""
    items = F.transform(listed_options(q), lambda x: F.regexp_extract(x, r"^\s*([A-Z])\s*[.):]", 1))
    lines = F.transform(F.split(q, LINES), lambda x: F.regexp_extract(trimmed(x), r"^\(?\s*([A-Z])\s*\)?\s*[.):]\s", 1))
    return F.array_sort(F.array_distinct(F.filter(F.concat(items, lines), lambda x: x != "")))


def option_ids(q: Column, *told: Column) -> Column:
    """Single capital letters of all sets told and of the question, sorted; A to D if there are none."""
    every = F.transform(F.concat(*told, option_letters(q)), lambda x: F.upper(trimmed(x)))
    own = F.array_sort(F.array_distinct(F.filter(every, lambda x: x.rlike("^[A-Z]$"))))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*map(F.lit, "ABCD")))


def answer_letter(text: Column, options: Column | None = None) -> Column:
    """The letter after Final Answer:, else the last capital standing alone, else UNPARSEABLE; UNPARSEABLE too if
    there are options and it is none of them."""
    named = F.upper(F.regexp_extract(text, r"(?i)final answer:\s*([A-Z])", 1))
    alone = F.regexp_extract(text, r"(?s)^(?:.*[^\p{L}\p{N}_])?([A-Z])(?:[^\p{L}\p{N}_].*)?$", 1)
    none = F.lit("UNPARSEABLE")
    got = F.when(F.coalesce(text, F.lit("")) == "", none).when(named != "", named).when(alone != "", alone).otherwise(none)
    return got if options is None else F.when((F.size(options) > 0) & ~F.array_contains(options, got), none).otherwise(got)


def time_text(seconds: Column) -> Column:
    s = seconds.cast("int")
    return F.format_string("%02d:%02d", (s / 60).cast("int"), s % 60)


def time_value(text: Column) -> Column:
    """Seconds of MM:SS or HH:MM:SS, else 0."""
    p = F.split(text, ":")
    n = lambda i: F.get(p, F.lit(i)).try_cast("int")
    two, three = n(0) * 60 + n(1), n(0) * 3600 + n(1) * 60 + n(2)
    return F.coalesce(F.when(F.size(p) == 2, two).when(F.size(p) == 3, three).cast("double"), F.lit(0.0))


def timeline_events(text: Column, duration: Column) -> Column:
    """Structs (start, end, description) of passages [MM:SS-MM:SS] text, any dash, over several lines too. An end
    not after its start is 5 s after it; one beyond duration + 10 is the duration; blank passages are left out."""
    # Fixed value: how a timed passage is marked.
    shape = r"(?s)\[(\d{1,2}:\d{2})\s*[-–—]\s*(\d{1,2}:\d{2})\]\s*(.+?)(?=\n\[|\n*\z)"
    part = lambda k: F.regexp_extract_all(text, F.lit(shape), k)

    def event(x):
        a, z = time_value(x["a"]), time_value(x["z"])
        later = F.when(z <= a, a + 5).otherwise(z)
        return F.struct(a.alias("start"), F.when(later > duration + 10, duration).otherwise(later).cast("double").alias("end"), trimmed(x["d"]).alias("description"))

    found = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("z"), part(3).alias("d")), event)
    return F.filter(found, lambda e: e["description"] != "")


def timeline(text: Column, duration: Column) -> Column:
    """Events of a text: its timed passages; where it has none, its lines."""
    timed = timeline_events(text, duration)
    return F.when(F.size(timed) > 0, timed).otherwise(timeline_lines(text, duration))


#: Words of questions that name nothing.
NO_ENTITY = ("based", "content", "whose", "viewpoint", "relatively", "according", "following", "statement", "correct", "incorrect", "true", "false", "options", "option", "answer", "video", "clip", "frame", "scene", "mainly", "about", "which", "what", "how", "who", "where", "when", "why", "of", "the", "a", "an", "in", "on", "at", "to", "for", "and", "or", "but", "not", "this", "that", "these", "those", "person", "someone", "something", "thing", "object", "item", "based on", "based-on")


def entities(k: Column) -> Column:
    """Keywords that name something: tagged text:, with a digit, a capital, or two letters one of which is Chinese.
    The first of each, whatever its case and spacing."""
    def named(x):
        low = F.regexp_replace(F.lower(x), r"\s+", " ")
        return ~low.isin(*NO_ENTITY) & (low.startswith("text:") | x.rlike(r"\p{Nd}|\p{Lu}") | (has_cjk(x) & (F.length(x) >= 2)))

    key = lambda x: F.regexp_replace(F.lower(x), r"\s+", " ")
    first = lambda kept: let(F.transform(kept, key), lambda keys: F.filter(kept, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    return let(F.filter(F.transform(k, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & named(x)), first)


def option_texts(q: Column) -> Column:
    """Letters and texts of the options that a question lists, as structs; of the same letter, the last. White space
    after the mark isn't needed here."""
    shape = r"^\(?\s*([A-Z])\s*\)?\s*[.):]\s*(.+)$"
    inner = r"(?s)^([A-Z])\s*[.):]\s*(.*)$"
    pair = lambda x, p: F.struct(F.regexp_extract(x, p, 1).alias("option"), trimmed(F.regexp_extract(x, p, 2)).alias("text"))
    items = F.transform(F.filter(F.transform(listed_options(q), trimmed), lambda x: x.rlike(inner)), lambda x: pair(x, inner))
    lines = F.transform(F.filter(F.transform(F.split(q, LINES), trimmed), lambda x: x.rlike(shape)), lambda x: pair(x, shape))
    each = F.concat(items, lines)
    return F.filter(each, lambda x, i: ~F.exists(F.slice(each, i + 2, F.greatest(F.size(each), F.lit(1))), lambda y: y["option"] == x["option"]))


def option_order(option: Column) -> Column:
    """Sort key: single letters, then numbers by value, then the rest."""
    o = F.upper(trimmed(F.coalesce(option, F.lit(""))))
    return F.when(o.rlike("^[A-Z]$"), F.concat(F.lit("0"), o)).when(o.rlike("^[0-9]{1,12}$"), F.concat(F.lit("1"), F.lpad(o, 12, "0"))).otherwise(F.concat(F.lit("2"), o))


def json_found(text: Column) -> Column:
    """The JSON in a model's reply: all of it, else what a fence holds, else its first object without inner ones;
    null where none of them can be read."""
    as_is = F.trim(text)
    fence = lambda mark: F.regexp_extract(text, r"(?s)```" + mark + r"\s*(.*?)\s*```", 1)
    read = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(read(as_is), read(fence("json")), read(fence("")), read(F.regexp_extract(text, r"\{[^{}]*\}", 0)))


def timeline_lines(text: Column, duration: Column) -> Column:
    """Events of a text without times: lines of ten letters or more, without their bullets, each in an equal slot."""
    told = lambda x: F.when(F.length(F.trim(x)) >= 10, F.trim(F.regexp_replace(F.trim(x), r"^[\d.\-*\s]+", ""))).otherwise("")
    each = lambda lines, slot: F.transform(lines, lambda x, i: F.struct((i * slot).alias("start"), ((i + 1) * slot).alias("end"), told(x).alias("description")))
    every = let(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n"), lambda lines: let(duration / F.size(lines), lambda slot: each(lines, slot)))
    return F.filter(every, lambda e: e["description"] != "")


def truth(text: Column, default: bool) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(F.lit(default))


def most_steps(options: Column, base: int = 10, usual: int = 4, extra: int = 1) -> Column:
    """Steps of the observation loop: base, and extra ones for each option beyond the usual number."""
    return F.lit(max(1, base)) + F.greatest(options - usual, F.lit(0)) * max(0, extra)


def pictured_stages(stages: Column, words: Column) -> Column:
    """All keywords of a plan: those of its stages in order (array of arrays), then the question's."""
    return F.concat(F.flatten(stages), words)


def request_id(message: Column) -> Column:
    """The id of the request that an error message names, or null."""
    quoted = F.regexp_extract(message, r'"request_id"\s*:\s*"([^"]+)"', 1)
    plain = F.regexp_extract(message, r"(?i)request[_-]?id[=:\s]+([A-Za-z0-9\x5C-\x5F.]+)", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")))


def is_transient(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, TRANSIENT)), lambda m: F.contains(low, m))


def is_out_of_memory(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.contains(low, F.lit("out of memory")) | F.contains(low, F.lit("cudaerrormemoryallocation"))


def model_spellings(name: Column) -> Column:
    """Other spellings under which a model may be known, each once."""
    now = F.trim(F.coalesce(name, F.lit("")))
    fixed = F.replace(now, F.lit("instrcut"), F.lit("instruct"))
    cands = F.array(
        F.when(fixed != now, fixed),
        F.when(F.contains(fixed, F.lit("qwen3vl-")), F.replace(fixed, F.lit("qwen3vl-"), F.lit("qwen3-vl-"))),
        F.when(F.contains(fixed, F.lit("qwen3-vl-")), F.replace(fixed, F.lit("qwen3-vl-"), F.lit("qwen3vl-"))),
    )
    return F.array_distinct(F.filter(cands, lambda x: x.isNotNull() & (x != "")))


def reply_content(reply: Column) -> Column:
    """What a reply in JSON says: the first choice's message or text, else its content, else all of it."""
    at = lambda path: F.get_json_object(reply, path)
    return F.coalesce(at("$.choices[0].message.content"), at("$.choices[0].text"), at("$.content"), reply, F.lit(""))


#: Counters of a reply's usage.
COUNTERS = ("prompt_tokens", "completion_tokens", "total_tokens", "input_tokens", "output_tokens", "image_tokens")


def usage(reply: Column) -> dict[str, Column]:
    """A reply's counters by name, as numbers or null; the nested one of images goes before the plain one."""
    at = lambda path: F.get_json_object(reply, f"$.usage.{path}").try_cast("double").cast("long")
    return {k: F.coalesce(at("prompt_tokens_details.image_tokens"), at(k)) if k == "image_tokens" else at(k) for k in COUNTERS}


def hint(question: Column, words: Column, option: Column, option_words: Column, option_query: Column, general: Column) -> Column:
    """The question that an observer is asked about a segment: with at most 20 keywords of the question, and those of
    the option and its query; without an option, the general query."""
    line = lambda head, x: F.when(F.size(x) > 0, F.concat(head, F.array_join(F.slice(x, 1, 20), ", ")))
    has = option.isNotNull()
    return trimmed(F.concat_ws(
        "\n",
        question,
        line(F.lit("Focus Keywords (query): "), words),
        F.when(has, line(F.concat(F.lit("Focus Keywords (option "), option, F.lit("): ")), option_words)),
        F.when(has & (option_query != ""), F.concat(F.lit("Focus Semantic Query (option "), option, F.lit("): "), option_query)),
        F.when(~has & (general != ""), F.concat(F.lit("Focus Semantic Query (general): "), general)),
    ))


def bare_query(text: Column, option: Column) -> Column:
    """A semantic query without its leading "If answer is X," and "The video should show:"."""
    lead = F.concat(F.lit(r"(?i)^if (?:the (?:correct )?)?answer is \Q"), option, F.lit(r"\E[, ]\s*"))
    now = F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), lead, F.lit(""))
    cut = F.when(F.contains(now, F.lit(":")), trimmed(F.regexp_replace(now, r"(?s)^[^:]*:", ""))).otherwise(F.lit(""))
    return F.when(F.startswith(F.lower(now), F.lit("the video should show")), cut).otherwise(now)


def read_text(strings: Column, most: int = 30) -> Column:
    """Text found in pictures: strings of over three letters, each once, at most so many."""
    return F.array_join(F.slice(F.array_distinct(F.filter(strings, lambda x: F.length(trimmed(x)) > 3)), 1, most), ", ")


def frame_time(frame: Column, fps: float = 1.0) -> Column:
    return F.format_string("%.1fs", frame / F.lit(fps))


def embedding(tokens_: Column, size: int = 64) -> Column:
    """A stand-in for a text encoder: tokens hashed into size signed counts, of unit length."""
    place = F.transform(tokens_, lambda t: F.md5(t.cast("binary")))
    place = F.transform(place, lambda h: F.struct((F.conv(F.substring(h, 1, 6), 16, 10).cast("int") % size).alias("k"), F.when(F.substring(h, 7, 1) < "8", 1.0).otherwise(-1.0).alias("x")))
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(place, zero, lambda acc, p: F.transform(acc, lambda x, i: F.when(i == p["k"], x + p["x"]).otherwise(x)))
    return F.aggregate(
        F.array(total),
        F.array().cast("array<double>"),
        lambda _, v: F.aggregate(F.array(F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))), F.array().cast("array<double>"), lambda _, n: F.transform(v, lambda x: x / n)),
    )


def coverage_bonus(flags: dict[str, Column]) -> Column:
    """Evenly spread frames that a kind of question gets on top."""
    return F.when(flags["count"], 12).when(flags["temporal"] | flags["text"] | flags["audio"], 8).otherwise(0)


def thinned(n: Column, most: int) -> Column:
    """Which of n pictures are sent if at most so many may be: evenly spread ones."""
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= most, F.sequence(F.lit(0), n - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * n / F.lit(most)).cast("int")))
