"""Scalar text functions as Column expressions (no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's ``str.split``/``\s`` treats as white space. Java's own
# classes miss several of them, so the class is always spelled out.
PY_WS = (r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# The same characters without the plain space, plus bell and backspace.
RARE_WS = (r"[\x07-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Characters beyond ASCII among which all such separators are, in few ranges that are quick to test.
FAR_WS = r"[\x{85}\x{a0}\x{1680}\x{3000}\x{2000}-\x{200a}\x{2028}-\x{205f}]"
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Passage and end-of-turn markers found in recorded model prompts.
PASSAGE_MARK = "Here is the passage."
TURN_END = "<|eot_id|>"
# Fixed value: suffix that separates concept ids from surface-name ids.
CONCEPT_SUFFIX = "_concept"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """Collapse every run of (Unicode) white space to one space and trim. Most texts hold single plain spaces alone: a
    scan for others decides whether runs are replaced at all."""
    t = _col(c)
    odd = F.contains(t, F.lit("  ")) | t.rlike(RARE_WS)
    return F.trim(F.when(odd, F.regexp_replace(t, PY_WS + "+", " ")).otherwise(t))


def remove_nul(c) -> Column:
    return F.translate(_col(c), "\x00", "")


def _control_to_space(c) -> Column:
    t = F.translate(_col(c), "\n\r\t\x0b\x0c\x08\x07;\x00", "       ,")
    return F.replace(t, F.lit("\\e"), F.lit(" "))


def clean_text(c) -> Column:
    """Name cleaning for the table path: control characters to spaces, ``;`` to ``,``, squeeze.

    Most names need no squeezing; a scan for two spaces or a rare separator decides, which halves
    the cost of the pass over all names.
    """
    t = F.replace(F.replace(F.replace(_col(c), F.lit("\x00"), F.lit("")), F.lit("\\e"), F.lit(" ")), F.lit(";"), F.lit(","))
    odd = F.contains(t, F.lit("  ")) | t.rlike(RARE_WS)
    return F.trim(F.when(odd, F.regexp_replace(t, PY_WS.replace("[", "[\\x07\\x08", 1) + "+", " ")).otherwise(t))


def nothing_to_clean(json) -> Column:
    """Whether `clean_text` could do no more than trim any string of a JSON text.

    Without a backslash no string holds a control character, and ASCII text then holds no white space but spaces.
    """
    t = _col(json)
    plain = (F.octet_length(t) == F.length(t)) | ~t.rlike(FAR_WS)
    return ~(F.contains(t, F.lit("\\")) | F.contains(t, F.lit(";")) | F.contains(t, F.lit("  "))) & plain


def clean_text_graph(c) -> Column:
    """Name cleaning for the direct graph path: same replacements, no squeeze and no trim."""
    return _control_to_space(c)


def sha_id(c) -> Column:
    return F.sha2(_col(c), 256)


def short_key(c) -> Column:
    """16 bytes that stand for a text where rows are shuffled or joined by it."""
    return F.unhex(F.md5(_col(c)))


def concept_id(c) -> Column:
    return F.sha2(F.concat(_col(c), F.lit(CONCEPT_SUFFIX)), 256)


def md5_id(c) -> Column:
    return F.concat(F.lit("n"), F.substring(F.md5(_col(c)), 1, 16))


def normalize_concept(c) -> Column:
    return squeeze(F.lower(_col(c)))


def concept_node_id(c) -> Column:
    return F.substring(F.sha2(normalize_concept(c), 256), 1, 16)


def is_blank(c) -> Column:
    return F.coalesce(squeeze(c), F.lit("")) == ""


def trim_passage(c) -> Column:
    """Text after the last passage mark and before the first end-of-turn token."""
    t = remove_nul(c)
    t = F.substring_index(t, PASSAGE_MARK, -1)
    return F.substring_index(t, TURN_END, 1)


def comma_list(c, keep_blank: bool = False, lower: bool = False) -> Column:
    """Split a model's comma separated answer into trimmed (optionally lower-cased) parts."""
    parts = F.transform(F.split(_col(c), ","), lambda x: squeeze(F.lower(x) if lower else x))
    return parts if keep_blank else F.filter(parts, lambda x: x != "")


def split_answer(c) -> Column:
    """Text after the last ``Answer:`` (else ``answer:``); an empty answer becomes ``none``."""
    t = _col(c)
    cut = (F.when(F.contains(t, F.lit("Answer:")), F.substring_index(t, "Answer:", -1))
           .when(F.contains(t, F.lit("answer:")), F.substring_index(t, "answer:", -1))
           .otherwise(t))
    return F.when(cut == "", F.lit("none")).otherwise(cut)


def normalize_answer(c) -> Column:
    """Lower case, hyphens to spaces, drop non-word characters, squeeze (articles are kept)."""
    t = F.replace(F.lower(_col(c)), F.lit("-"), F.lit(" "))
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", "")
    return squeeze(t)


def first_line_after(c, marker: str) -> Column:
    """First line of the text that follows the first ``marker``; NULL without a marker."""
    parts = F.split(_col(c), marker, -1)
    return F.when(F.size(parts) > 1, F.substring_index(F.get(parts, 1), "\n", 1))


def react_thought(c) -> Column:
    return first_line_after(c, "Thought:")


def react_action(c) -> Column:
    return first_line_after(c, "Action:")


def react_answer(c) -> Column:
    parts = F.split(_col(c), "Answer:", -1)
    return F.when(F.size(parts) > 1, squeeze_ends(F.get(parts, 1)))


def react_search_query(action) -> Column:
    """Text after the last lower-case ``search for``; the whole action when it is absent."""
    return squeeze_ends(F.substring_index(_col(action), "search for", -1))


def strip_think(c) -> Column:
    """Final answer of a reasoning model: what follows the last ``</think>``."""
    return squeeze_ends(F.substring_index(_col(c), "</think>", -1))


def squeeze_ends(c) -> Column:
    """Python ``strip``: drop leading and trailing white space only."""
    return F.regexp_replace(F.regexp_replace(_col(c), "^" + PY_WS + "+", ""), PY_WS + r"+\z", "")


def from_first_letter(c) -> Column:
    return F.regexp_extract(_col(c), "(?s)[a-zA-Z].*", 0)


def first_choice_letter(c) -> Column:
    """First A-D letter, upper-cased; empty string when there is none."""
    return F.upper(F.regexp_extract(_col(c), "(?i)[a-d]", 0))


def wrong_segment_ids(answer, n_segments) -> Column:
    """Segment numbers named after the first ``Answer: ``, kept when 1..n; without it, and with
    ``ALL_CORRECT``, there are none.

    Number 0 is ignored: indexing with it would silently address the last segment.
    """
    t = _col(answer)
    tail = F.regexp_extract(t, "(?s)Answer: (.*)", 1)
    ids = F.transform(F.regexp_extract_all(tail, F.lit(r"\d+"), 0), lambda x: F.try_to_number(x, F.lit("9999999999")).cast("bigint"))
    ok = F.filter(ids, lambda x: (x >= 1) & (x <= _col(n_segments)))
    return F.when(F.contains(t, F.lit("ALL_CORRECT")), F.array().cast("array<bigint>")).otherwise(F.array_distinct(ok))


def count_listed(c, none_phrase: str = "All recognized") -> Column:
    """Number of non-blank lines of a listing answer (at least one); the phrase means 0."""
    lines = F.filter(F.split(_col(c), "\n"), lambda x: ~is_blank(x))
    return F.when(F.contains(_col(c), F.lit(none_phrase)), F.lit(0)).otherwise(
        F.greatest(F.size(lines), F.lit(1)))


def bracket_items(c) -> Column:
    """Quoted items of the first bracketed list on every line of an answer."""
    inner = F.transform(F.split(_col(c), "\n"), lambda x: F.regexp_extract(x, r"\[(.*?)\]", 0))
    lists = F.transform(F.filter(inner, lambda x: x != ""),
                        lambda x: F.split(F.btrim(x, F.lit("[]")), "', '"))
    return F.transform(F.flatten(lists), lambda x: F.btrim(x, F.lit("'")))


def relation_path(path) -> Column:
    """``/d/c/r`` or two such paths joined by ``.``: array of (relation, concepts)."""
    halves = F.slice(F.split(_col(path), r"\."), 1, 2)

    def half(h):
        seg = F.split(h, "/")
        return F.struct(F.element_at(seg, -1).alias("relation"),
                        F.slice(seg, 2, F.greatest(F.size(seg) - 2, F.lit(0))).alias("concepts"))
    return F.transform(halves, half)


def strip_punctuation(c) -> Column:
    return F.lower(F.translate(_col(c), PUNCTUATION, ""))


def words_of(c) -> Column:
    """Distinct lower-case words after dropping everything that is not alphanumeric or space."""
    t = F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}\s\x{a0}\x{2000}-\x{200a}\x{3000}]", "")
    return F.array_distinct(F.filter(F.split(squeeze(t), " "), lambda x: x != ""))


def phrase(c, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of a name in order, without ASCII punctuation and stop words, joined by spaces."""
    words = F.filter(F.split(squeeze(F.lower(F.regexp_replace(_col(c), r"\p{Punct}", ""))), " "), lambda w: (w != "") & ~w.isin(*stop_words))
    return F.array_join(words, " ")


def tokens(c) -> Column:
    """Python ``str.split()``: white-space separated tokens, none for a blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda x: x != "")


def path_text(nodes_and_relations) -> Column:
    """``a --->rel --->b``: every element followed by an arrow, without the final arrow."""
    return F.array_join(_col(nodes_and_relations), " --->")


def triple_text(h, r, t, style: str = "paren") -> Column:
    """The three printed triple formats: ``(h, r, t)``, two-space wide and plain."""
    h, r, t = _col(h), _col(r), _col(t)
    if style == "paren":
        return F.concat(F.lit("("), h, F.lit(", "), r, F.lit(", "), t, F.lit(")"))
    return F.concat_ws("  " if style == "wide" else " ", h, r, t)


def rating(c) -> Column:
    """Integer rating of one path; NULL for anything that is not an integer."""
    return squeeze_ends(c).try_cast("int")


def rating_list(c, n) -> Column:
    """Comma separated ratings, digits only, trimmed to the number of rated paths."""
    parts = F.filter(F.transform(F.split(_col(c), ","), squeeze_ends), lambda x: x.rlike(r"^\d+\z"))
    return F.slice(F.transform(parts, lambda x: x.cast("int")), 1, n)


def regex_pick(c, pattern: str, group: int = 0, select: int = 0, fallback: str = "[invalid]") -> Column:
    """``select``-th match of ``pattern`` (negative counts from the end), trimmed, or ``fallback``."""
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))
    at = select + 1 if select >= 0 else select
    return F.coalesce(squeeze_ends(F.try_element_at(found, F.lit(at))), F.lit(fallback))


def first_char_choice(c, pattern: str, fallback: str = "[invalid]") -> Column:
    """Choice filter that drops ``:``, strips and keeps the first character of the match.

    A parenthesised choice therefore yields ``(``; kept, because the later punctuation-blind
    exact match scores it the same way.
    """
    hit = F.regexp_extract(_col(c), pattern, 0)
    first = F.substring(squeeze_ends(F.replace(hit, F.lit(":"), F.lit(""))), 1, 1)
    return F.when(first != "", first).otherwise(F.lit(fallback))


def ngram_normalize(c) -> Column:
    """ASCII lower-casing plus removal of ASCII punctuation; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(_col(c), upper + PUNCTUATION, upper.lower())


def exact_match_form(c, ignore_regexes=(), ignore_case=False, ignore_punctuation=False,
                     ignore_numbers=False) -> Column:
    """Comparison form for exact match: regexes, then case, then punctuation, then digits."""
    t = _col(c)
    for rx in ignore_regexes:
        t = F.regexp_replace(t, rx, "")
    if ignore_case:
        t = F.lower(t)
    if ignore_punctuation:
        t = F.translate(t, PUNCTUATION, "")
    if ignore_numbers:
        t = F.translate(t, "0123456789", "")
    return t


def detokenize(c) -> Column:
    """Undo corpus tokenisation around contractions, brackets, quotes and punctuation."""
    t = _col(c)
    # The replaced sequences, in their order.
    for old, new in [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')]:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.regexp_replace(t, r" (['.,])", "$1")


def last_question(prompt) -> Column:
    """Text after the last ``Question:``; NULL when the prompt holds none."""
    p = _col(prompt)
    return F.when(F.contains(p, F.lit("Question:")), squeeze_ends(F.substring_index(p, "Question:", -1)))


def safe_name(c) -> Column:
    """Model name usable in a file name: runs of reserved characters become ``__``."""
    return F.regexp_replace(_col(c), r"[\"<>:/|\\?*\[\]]+", "__")


def utf8_bytes(c) -> Column:
    return F.octet_length(_col(c))


def word_count(c) -> Column:
    """``len(re.split('\\s+', text))``: leading or trailing white space adds an empty word."""
    return F.size(F.split(_col(c), PY_WS + "+", -1))
