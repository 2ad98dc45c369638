"""Cleaning, tokenizers, names and other scalar expressions, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """What differs by language: filler words, role keywords, tokens of Self-BLEU."""

    fillers: tuple[str, ...] = ()
    agent: tuple[str, ...] = ("agent",)
    client: tuple[str, ...] = ("client", "customer")
    bleu_clean: bool = True
    bleu_alpha: bool = False
    unit: str = "conversation"
    stopwords: tuple[str, ...] = field(default=())


# Filler words and role keywords of each language.
PROFILES = {
    "et": Profile(("hmmm", "mhm", "ahaa", "aha", "okei", "ok"), ("agent", "abistaja", "klienditeenindaja", "teenindaja"), ("klient", "kasutaja", "client", "customer"), bleu_clean=False, unit="turn"),
    "fi": Profile(("hmmm", "mhm", "aha", "okei", "ok", "joo"), ("agentti", "agent"), ("asiakas", "klient")),
    "hu": Profile(("hmmm", "mhm", "aha", "oké", "ok"), ("ügynök", "agent"), ("ügyfél", "kliens"), bleu_alpha=True),
}


# Names of languages, of their metric files and of the speakers of labelled samples.
LANGUAGES = {"et": "Estonian", "fi": "Finnish", "hu": "Hungarian", "en-us": "English"}
LANGUAGE_FILES = {"et": "estonian", "fi": "finnish", "hu": "hungarian"}
SPEAKERS = {"et": ("Agent", "Klient"), "fi": ("Agentti", "Asiakas"), "hu": ("Ügynök", "Ügyfél")}

#: Three short conversations of each language, for use where no file is given.
SAMPLES = {
    "et": ("Klient: Tere! Minu arve on vale.\nAgent: Tere! Vaatan kohe järele.", "Klient: Pakk ei tulnud.\nAgent: Saadan uue homme.", "Agent: Kuidas saan aidata?\nKlient: Soovin lepingu lõpetada."),
    "fi": ("Asiakas: Hei! Laskuni on väärin.\nAgentti: Hei! Tarkistan asian heti.", "Asiakas: Paketti ei tullut.\nAgentti: Lähetän uuden huomenna.", "Agentti: Miten voin auttaa?\nAsiakas: Haluan lopettaa sopimuksen."),
    "hu": ("Ügyfél: Jó napot! Hibás a számlám.\nÜgynök: Jó napot! Azonnal megnézem.", "Ügyfél: Nem jött meg a csomag.\nÜgynök: Holnap küldök egy újat.", "Ügynök: Miben segíthetek?\nÜgyfél: Fel szeretném mondani a szerződést."),
}


def language_name(code: Column) -> Column:
    """The name of a language, or its code."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), code), code)


def turns(messages: Column, cleaned: Callable[[Column], Column] | None = None) -> Column:
    """(speaker, text, is_agent) of the messages that aren't blank, texts cleaned by ``cleaned`` if given."""
    kept = F.filter(messages, lambda m: ~blank(m["message"]))
    text = cleaned or (lambda c: c)
    return F.transform(kept, lambda m: F.struct(F.coalesce(truthy(m["from_name"]), F.lit("Unknown")).alias("speaker"), text(m["message"]).alias("text"), is_agent(m["from_type"]).alias("is_agent")))


# The parts of a prompt, in order, with what stands for an absent one.
PROMPT_PARTS = {
    "language": ("Language", "en-us"),
    "industry": ("Industry", "Retail"),
    "problem": ("Customer problem", "General inquiry"),
    "n_messages": ("Number of messages", "6"),
    "n_agents": ("Number of agents", "1"),
    "agent_names": ("Agent names", ""),
    "channel": ("Channel", "chat"),
    "agent_experience": ("Agent experience level", "senior"),
    "agent_type": ("Agent type", "human"),
}


def prompt_part(name: str, value: Column | None) -> Column:
    """The value of a part of a prompt in words: the language by name and code, names of agents in a row."""
    text = F.lit(None).cast("string") if value is None else F.array_join(value, ", ") if name == "agent_names" else value.cast("string")
    text = F.coalesce(text, F.lit(PROMPT_PARTS[name][1]))
    if name == "language":
        return F.concat(language_name(text), F.lit(" ("), text, F.lit(")"))
    return F.concat(text, F.lit(" agent(s)")) if name == "n_agents" else text


def config_prompt(config: dict[str, Column]) -> Column:
    """All parts of a prompt from a configuration, a line each; an absent part has its default."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"- {label}: "), prompt_part(name, config.get(name))) for name, (label, _) in PROMPT_PARTS.items()))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Null where a string is empty."""
    return F.when(c != "", c)


def clean(c: Column, profile: Profile = Profile()) -> Column:
    """White space to single spaces, ends stripped, then bracketed parts and filler words removed."""
    out = F.regexp_replace(strip(F.regexp_replace(c, r"(?U)\s+", " ")), r"\[.*?\]", "")
    out = F.regexp_replace(out, r"\(.*?\)", "")
    return F.regexp_replace(out, rf"(?iU)\b({'|'.join(profile.fillers)})\b", "") if profile.fillers else out


def tokens(c: Column, stopwords: tuple[str, ...] = (), least: int = 1) -> Column:
    """Lower-cased words of letters, digits and underscores, of ``least`` characters or more."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    keep = F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found
    return F.filter(keep, lambda t: ~t.isin(*stopwords)) if stopwords else keep


def alpha_tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """White-space tokens of letters only, lower-cased."""
    parts = F.filter(F.split(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: F.rlike(t, F.lit(r"^\p{L}+$")))
    low = F.transform(parts, lambda t: F.lower(t))
    return F.filter(low, lambda t: ~t.isin(*stopwords)) if stopwords else low


def is_agent(kind: Column) -> Column:
    return F.when(kind.isin("agent", "assistant"), True).when(kind.isin("customer", "user"), False)


def role(speaker: Column, flag: Column, profile: Profile) -> Column:
    """agent or client from the flag, else from keywords in the speaker's name (agents first)."""
    low = F.lower(speaker)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    words = F.when(has(profile.agent), "agent").when(has(profile.client), "client")
    return F.when(flag, "agent").when(~flag, "client").otherwise(words)


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def formatted(turns: Column) -> Column:
    """speaker: text lines of an array of turns."""
    lines = F.transform(turns, lambda t: F.concat(t.speaker, F.lit(": "), t.text))
    return F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n        "))


def parse_labelled(c: Column, speakers: tuple[str, ...]) -> Column:
    """Turns (speaker, text) of a text whose turns begin with ``Speaker:``."""
    names = "|".join(speakers)
    heads = F.regexp_extract_all(c, F.lit(rf"({names}):"), F.lit(1))
    bodies = F.slice(F.split(c, rf"(?:{names}):"), 2, 1 << 20)
    return F.transform(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda t: F.struct(t["h"].alias("speaker"), strip(t["b"]).alias("text")))


def file_language(name: Column) -> Column:
    # Fixed value: the form of the names.
    return truthy(F.regexp_extract(name, r"^convo_.+_([a-z]{2}(?:-[a-z]{2})?)_\d{8}-\d{6}\.jsonl$", 1))


# Fixed value: the form of the names.
FILE_PARTS = r"convo_(.+)_([a-z-]+)_(\d{8}-\d{6})"


def file_parts(stem: Column) -> Column:
    """(model, language, datetime) of a file's stem, each ``unknown`` where it has another form."""
    part = lambda i: F.coalesce(truthy(F.regexp_extract(stem, FILE_PARTS, i)), F.lit("unknown"))
    return F.struct(part(1).alias("model"), part(2).alias("language"), part(3).alias("datetime"))


def judge_of_file(name: Column) -> Column:
    # Fixed value: the form of the names.
    return truthy(F.regexp_extract(name, r"label_recovery_(.+?)_([a-z]{2})_\d{8}-\d{6}\.jsonl", 1))


def source_language(source: Column, path: Column) -> Column:
    """Language from ``combined_xx.json``, else from the path, else unknown."""
    # The forms of the names.
    return F.coalesce(truthy(F.regexp_extract(source, r"combined_([a-z]{2})\.json", 1)), truthy(F.regexp_extract(path, r"[_-]([a-z]{2})[_.]", 1)), F.lit("unknown"))


def language_of(name: Column, metadata: Column, metadata_first: bool = False) -> Column:
    found = [file_language(name), truthy(metadata)]
    return F.coalesce(*(found[::-1] if metadata_first else found), F.lit("unknown"))


def combined_stem(stem: Column) -> Column:
    return F.when(F.startswith(stem, F.lit("combined_")), F.substring(stem, 10, 1 << 20)).otherwise("unknown")


def conversation_name(model: Column, language: Column, when: Column, index: Column) -> Column:
    return F.format_string("%s_%s_%s_%04d", model, language, when, index.cast("int"))


def size_bucket(n: Column) -> Column:
    return F.when(n < 1000, "n<1K").when(n < 10_000, "1K<n<10K").when(n < 100_000, "10K<n<100K").when(n < 1_000_000, "100K<n<1M").otherwise("n>1M")


def shortened(c: Column, most: int = 25) -> Column:
    """The first ``most`` characters and an ellipsis of what is longer."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def fixed(c: Column, digits: int = 2) -> Column:
    """A number with ``digits`` decimals as C and Python print it: the double's exact value, halves to even. ``format_string`` rounds its shortest decimal form.

    Numbers whose shortest form has fewer decimals than that (from some 10**13 on) get zeros for the rest.
    """
    odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(odd, F.call_function("format_number", c, F.lit("0." + "0" * digits if digits else "0")))


def mean_std(mean: Column, std: Column) -> Column:
    """Mean and deviation, or the mean alone where that has none."""
    mean, std = fixed(mean.cast("double")), fixed(std.cast("double"))
    return F.when(std.isNull(), mean).otherwise(F.concat(mean, F.lit("±"), std))


def replaced(c: Column, old: str, new: str) -> Column:
    """Each character of ``old`` by ``new``."""
    return F.translate(c, old, new * len(old))


def dataset_name(model: Column, prefix: str = "controlled-generated-convos-") -> Column:
    """The name of a model's dataset; dots stay."""
    return F.concat(F.lit(prefix), F.lower(replaced(model, "/_", "-")))


def model_tag(model: Column) -> Column:
    return F.lower(replaced(model, "/_.", "-"))


def citation_key(model: Column) -> Column:
    return replaced(model, ".-/", "_")


def dataset_description(model: Column, languages: Column, start: str = "Synthetic customer support conversations generated using ") -> Column:
    """A sentence on the model and one on the languages (an array), if there are any."""
    more = F.when(F.size(languages) > 0, F.concat(F.lit(" Available in languages: "), F.array_join(languages, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit(start), model, F.coalesce(more, F.lit("")))


def judge_name(model: Column, effort: Column) -> Column:
    return F.replace(F.concat_ws("-", model, truthy(effort)), F.lit("/"), F.lit("-"))


# What goes from a model's name for display, wherever it stands, one after the other.
VENDORS = ("anthropic.", "cohere.", "meta.", "mistral.")


def display_name(c: Column) -> Column:
    for vendor in VENDORS:
        c = F.replace(c, F.lit(vendor), F.lit(""))
    return c


def successful(*labels: Column) -> Column:
    out = F.lit(True)
    for c in labels:
        out = out & (F.coalesce(c, F.lit("")) != "")
    return out


def prompt(template: str, messages: Column) -> Column:
    """The template with ``{conversation}`` as one line a message; an absent name or kind is unknown, an absent text empty."""
    given = lambda c, default: F.coalesce(c, F.lit(default))
    lines = F.transform(messages, lambda m: F.concat(given(m.from_name, "Unknown"), F.lit(" ("), given(m.from_type, "unknown"), F.lit("): "), given(m.message, "")))
    return F.replace(F.lit(template), F.lit("{conversation}"), F.array_join(lines, "\n"))


def pluggable_tokens(make: Callable[[], Callable[[str], list[str]]] | None, stopwords: tuple[str, ...] = (), least: int = 2) -> Callable[[Column], Column]:
    """A tokenizer of words or lemmas of the caller's own, loaded once a worker; where it can't be loaded, or none is given, the built-in one.

    Words that aren't letters only, shorter than ``least`` or stopwords go.
    """
    try:
        probe = make() if make else None
    except ImportError:
        probe = None
    if probe is None:
        return lambda c: tokens(c, stopwords, least)
    held: list = []

    def run(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(make())
        keep = lambda t: t.isalpha() and len(t) >= least and t.lower() not in stopwords
        return texts.fillna("").map(lambda text: [t.lower() for t in held[0](text) if keep(t)])

    return F.pandas_udf(run, "array<string>")


def parse_languages(given: str, known: tuple[str, ...]) -> list[str]:
    """The languages of a comma-separated list, once each in order; unknown ones are an error."""
    found = list(dict.fromkeys(x.strip().lower() for x in given.split(",") if x.strip()))
    unknown = [x for x in found if x not in known]
    if unknown or not found:
        raise ValueError(f"unknown languages: {unknown}" if unknown else "no language given")
    return found


# Fixed value: the form of times in the names of files.
STAMP = "yyyyMMdd-HHmmss"


def stamp(when: Column) -> Column:
    return F.date_format(when, STAMP)


def stamp_time(c: Column) -> Column:
    """The time of a stamp; null where it has another form."""
    return F.try_to_timestamp(c, F.lit(STAMP))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds."""
    return F.unix_timestamp(F.date_trunc("second", end)) - F.unix_timestamp(F.date_trunc("second", start))


def looked_up(values: Column, key: str, default: str) -> Column:
    """The value of a key in a map, or the default."""
    return F.coalesce(F.try_element_at(values, F.lit(key)), F.lit(default))


def merged(first: Column, second: Column) -> Column:
    """Both maps; of a key that both have, the second's value counts."""
    own = F.map_filter(first, lambda key, _: ~F.array_contains(F.map_keys(second), key))
    return F.map_concat(own, second)


def parsed_values(c: Column) -> Column:
    """The values of a flat JSON object, as strings, in its order; null where it isn't one."""
    return F.map_values(F.from_json(c, "map<string,string>"))
