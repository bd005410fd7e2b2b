"""PII: detected entities get keyed, type-consistent surrogates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, table, written

#: Titles that show a person's gender, and those that don't.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Rev")
_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
#: What people say before their own names.
CUES = ("my name is", "full name:", "name:", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "mi chiamo", "меня зовут", "με λένε")
_CUES = "|".join(CUES)
#: Small words within family names, and words before which a capital word is no name.
_PARTICLE = r"(?:da|de|di|du|del|della|den|der|dos|la|le|van|von|zu|bin|ibn|al|el|ten|ter)"
_ARTICLE = r"(?i:the|a|an|this|that|each|every|any|no|der|die|das|ein|eine|le|la|les|un|une|el|los|las|una)"
#: A word of a name: inner capitals, apostrophes and hyphens, or an initial. Patterns here are possessive or bounded: no text is
#: held on the stack or tried again from its middle.
_WORD = rf"(?!(?:{_TITLES})\b)\p{{Lu}}(?:\.|[\p{{L}}\p{{M}}]*+(?:['’-][\p{{L}}\p{{M}}]++)*+)"
_NAME = rf"(?:{_PARTICLE} ){{0,3}}{_WORD}(?: (?:{_PARTICLE} ){{0,3}}{_WORD}){{0,4}}"
#: Kinds of entities in the order in which they are tried, each with its pattern.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]{1,63}+(?:\.[\p{L}\p{M}\p{N}-]{1,63}+){0,40}\.[\p{L}\p{M}]{2,24}+(?![\p{L}\p{N}-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "secret": r"""(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3})["']?+[^\s"',;]{6,}+["']?+""",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    # after a title or a cue, or a line of two words and more above one of a house number and a street
    "name": rf"\b(?:{_TITLES})\b\.?+ {_NAME}|(?<![\p{{L}}\p{{N}}])(?iu:{_CUES}) {_NAME}|(?<![^\n]){_WORD} {_NAME}(?=\n\d{{1,5}}[A-Za-z]? \p{{Lu}})",
}
PATTERN = "|".join(KINDS.values())
#: All entities but names hold one of these marks; names need a title or a cue, or a house number below them.
_HINT = rf"[@\d]|(?i:password|passwd|pwd|token|secret|api)|\b(?:{_TITLES})\b|(?iu:{_CUES})"
#: Country codes of one and two digits; all others have three. Fixed values of the numbering plan.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def kind_of(v: Column) -> Column:
    out = F
    for name, p in KINDS.items():
        out = out.when(v.rlike(f"^(?:{p})$"), name)
    return out.otherwise("other")


def _digest(v: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), attempt.cast("string"), v).cast("binary"), 512)


def _number(d: Column, i, most: int) -> Column:
    """A number under most from the digest, different for each i."""
    return F.pmod(F.xxhash64(d, i if isinstance(i, Column) else F.lit(i)), F.lit(most)).cast("int")


def _pick(d: Column, i, letters: str) -> Column:
    return F.substr(F.lit(letters), _number(d, i, len(letters)) + 1, F.lit(1))


def _same_classes(v: Column, d: Column, counted: Column | None = None) -> Column:
    """v with every letter and digit replaced by one of its class and script; hex strings stay hex; marks stay. counted: whether
    what a letter or digit becomes depends on how many come before it, not on its place, so that marks make no difference."""
    no_mark = lambda i: F.length(F.regexp_replace(F.substr(v, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    hexed = v.rlike("^[0-9a-f]+[\"']?$") & v.rlike("[a-f]") & v.rlike("[0-9]")

    def one(c: Column, i: Column) -> Column:
        i = i if counted is None else F.when(counted, no_mark(i)).otherwise(i)
        lower = F.when(hexed, _pick(d, i, "abcdef")).otherwise(_pick(d, i, "abcdefghijklmnopqrstuvwxyz"))
        return (
            F.when(c.between("0", "9"), _pick(d, i, "0123456789"))
            .when(c.between("a", "z"), lower)
            .when(c.between("A", "Z"), _pick(d, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(F.lower(c) == c, _pick(d, i, "абвгдежзиклмнопрстуфхцчшэюя")).otherwise(_pick(d, i, "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")))
            .when(c.rlike(r"^\p{IsGreek}$"), F.when(F.lower(c) == c, _pick(d, i, "αβγδεζηθικλμνξοπρστυφχψω")).otherwise(_pick(d, i, "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")))
            .when(c.rlike(r"^\p{IsHan}$"), _pick(d, i, "山川田中村木林森石原水火土金月日"))
            .when(c.rlike(r"^\p{IsHiragana}$"), _pick(d, i, "あいうえおかきくけこさしすせそ"))
            .when(c.rlike(r"^\p{IsKatakana}$"), _pick(d, i, "アイウエオカキクケコサシスセソ"))
            .when(c.rlike(r"^\p{IsHangul}$"), _pick(d, i, "가나다라마바사아자차카타파하"))
            .when(c.rlike(r"^\p{Lu}$"), _pick(d, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"^\p{L}$"), lower)
            .when(c.rlike(r"^\p{N}$"), _pick(d, i, "0123456789"))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(v, ""), one), "")


#: Syllables of made-up names by script, and endings of given names by gender.
_SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo", "us on an", "a ina elle"),
    "cyrillic": ("ба бе би бо да де ди до га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во", "ан ей ор", "а ина ия"),
    "greek": ("βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το", "ος ας ης", "α η ινα"),
}


#: What stands before a name: a title or a cue.
_LEAD = rf"^(?:(?:{_TITLES})\b\.?+|(?iu:{_CUES})) "


def lead(v: Column) -> Column:
    """What stands before the words of a name; empty if nothing does."""
    return F.regexp_extract(v, _LEAD, 0)


def name_words(v: Column) -> Column:
    """The words of a name as struct(kind, v): given (male or female where the title says so), initial, particle, and the last
    as family."""
    words = F.split(F.substr(v, F.length(lead(v)) + 1), " ")
    title = F.regexp_extract(lead(v), r"^[^. ]+", 0)
    given = F.when(title.isin(*FEMALE), "given female").when(title.isin(*MALE), "given male").otherwise("given")
    kind = lambda w, i: F.when(i == F.size(words) - 1, "family").when(w.rlike(rf"^{_PARTICLE}$"), "particle").when(w.endswith("."), "initial").otherwise(given)
    return F.transform(words, lambda w, i: F.struct(kind(w, i).alias("kind"), w.alias("v")))


def name_parts(v: Column) -> Column:
    """The words of a name that get surrogates."""
    return F.filter(name_words(v), lambda w: w["kind"] != "particle")


def spelled_name(email: Column, text: Column) -> Column:
    """Given and family name, as entities, of an address whose local part spells them, if the text has them side by side."""
    words = F.split(F.regexp_extract(email, r"^(\p{L}{2,40}[._-]\p{L}{2,40})@", 1), "[._-]")
    one = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.initcap(F.get(words, F.lit(k))).alias("v"))
    both = F.array(one("given", 0), one("family", 1))
    return F.when((F.size(words) == 2) & F.contains(text, F.concat_ws(" ", F.transform(both, lambda x: x["v"]))), both).otherwise(F.array().cast("array<struct<kind:string,v:string>>"))


def _made_name(v: Column, kind: Column, d: Column) -> Column:
    """A made-up word in the same script, hyphens and apostrophes in their places, a single letter before one stays single;
    given names end as the gender does."""

    def made(script: str) -> Column:
        syllables, male_end, female_end = (F.array(*map(F.lit, x.split())) for x in _SYLLABLES[script])
        part = lambda i, k: F.get(syllables, _number(d, i * 8 + k, len(_SYLLABLES[script][0].split())))
        word = lambda i: F.initcap(F.concat(part(i, 0), part(i, 1), part(i, 2)))
        ending = lambda i: F.when(kind == "given female", F.get(female_end, _number(d, i * 8 + 7, 3))).when(kind == "given male", F.get(male_end, _number(d, i * 8 + 7, 3))).otherwise(part(i, 5))
        whole = lambda w, i: F.when(w.rlike(r"^\p{L}\p{M}*['’-]?$"), F.upper(F.substr(part(i, 3), F.lit(1), F.lit(1)))).otherwise(F.concat(word(i), ending(i)))
        return F.array_join(F.transform(F.split(v, "(?<=['’-])"), lambda w, i: F.concat(whole(w, i), F.regexp_extract(w, "['’-]?$", 0))), "")

    return F.when(v.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(v.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def identity(v: Column, kind: Column) -> Column:
    """What the same entity has in common in all its spellings: addresses and hosts in lower case, numbers without the marks
    between their digits, labels of secrets aside."""
    digits = F.regexp_replace(v, "[^0-9A-Za-z+]", "")
    return F.when(kind == "email", F.lower(v)).when(kind.isin("card", "ssn", "phone", "iban"), digits).otherwise(v)


def surrogate(v: Column, kind: Column, key: str, attempt: Column) -> Column:
    """The keyed surrogate of an entity. Format: letters and digits keep their class, marks their place. An email's
    domain becomes one under "example" with its own ending, an address one of network 10, a phone keeps its country code, a
    secret its label. Card numbers are not made to pass the checksum, so that no real one can arise."""
    d = _digest(identity(v, kind), key, attempt)
    local, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    label = F.substring_index(domain, ".", 1)
    email = F.concat(_same_classes(local, d), F.lit("@"), _same_classes(label, F.sha2(d, 256)), F.lit(".example."), F.substring_index(domain, ".", -1))
    ip = F.concat_ws(".", F.lit("10"), *[_number(d, i, 256).cast("string") for i in range(3)])
    code = F.regexp_extract(v, _CODE, 0)
    number = _same_classes(v, d, kind.isin("card", "ssn", "phone", "iban"))
    phone = F.concat(code, F.substr(number, F.length(code) + 1))
    head = F.regexp_extract(v, r"""^[A-Za-z_-]+\s*[=:]\s*["']?""", 0)
    secret = F.concat(head, _same_classes(F.substr(v, F.length(head) + 1), d))
    access = F.concat(F.substr(v, F.lit(1), F.lit(4)), _same_classes(F.substr(v, F.lit(5)), d))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "secret", secret).when(kind == "key", access).when(kind.isin("family", "given", "given male", "given female"), _made_name(v, kind, d)).when(kind == "initial", F.concat(_pick(d, 0, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("."))).otherwise(number)


def surrogates(entities: DataFrame, key: str, attempts: int = 12) -> DataFrame:
    """entities: distinct (kind, v): (kind, v, s) with s distinct within a kind and never an entity of the input.

    Collisions are found by grouping on s (one small group for each surrogate) and joining with the entities; all but
    the first of a group are made again with another attempt, until none is left.
    """
    all_v = entities.select("kind", F.col("v").alias("s"))
    open_, done = entities, None
    for k in range(attempts):
        tried = open_.withColumn("s", surrogate(F.col("v"), F.col("kind"), key, F.lit(k)))
        first = F.row_number().over(Window.partitionBy("kind", "s").orderBy("v")) == 1
        tried = tried.withColumn("ok", first).join(all_v.withColumn("real", F.lit(True)), ["kind", "s"], "left")
        if done is not None:
            tried = tried.join(done.select("kind", "s", F.lit(True).alias("taken")), ["kind", "s"], "left")
        taken = F.col("taken").isNull() if done is not None else F.lit(True)
        tried = written(tried.select("kind", "v", "s", (F.col("ok") & F.col("real").isNull() & taken).alias("ok")), "pii-tried")
        good = tried.where("ok").select("kind", "v", "s")
        done = good if done is None else done.unionByName(good)
        open_ = tried.where("not ok").select("kind", "v")
        if open_.isEmpty():
            return done
    # what still collides (a space too small for its entities) gets a longer form: distinct by construction
    return done.unionByName(open_.select("kind", "v", F.concat(surrogate(F.col("v"), F.col("kind"), key, F.lit(attempts)), F.lit("-"), F.substr(_digest(F.col("v"), key, F.lit("long")), F.lit(1), F.lit(32))).alias("s")))


def replace_pii(docs: DataFrame, key: str = "surrogates") -> DataFrame:
    """docs with every detected entity in text replaced by its surrogate, and n_entities; other columns stay.

    Equal entities have equal surrogates in all documents, different ones of a kind different ones. Spellings of one
    address or number (case of letters, marks between digits) differ in their surrogates as they do in the text. Names are
    found by titles, by what people say before their own names, by an address below them, and by email addresses that spell
    them. They are replaced by their words, particles aside, so Mr. John Smith and Mr. Smith still share a family name. Where a
    text has a name, its given names are replaced before another capital word, too, and its family name by itself, but
    not after an article. Only texts with entities are shuffled: their entities meet the surrogates, and are put back by the
    text's digest. Null text: null, 0 entities. Repeated rows: alike. An own column n_entities gives way. Empty table: no rows.
    """
    kept = [c for c in docs.columns if c != "n_entities"]
    d = docs.select(*kept)
    md5, found, map_, spoken = free_names(d, "_md5", "_found", "_map", "_spoken")
    with_any = F.coalesce(F.col("text").rlike(_HINT) & F.col("text").rlike(PATTERN), F.lit(False))
    rows = d.where(F.col("text").rlike(_HINT)).withColumn(found, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).where(F.size(found) > 0)
    rows = rows.withColumn(found, F.transform(found, lambda v: F.struct(kind_of(v).alias("kind"), v.alias("v"))))
    # the words of a text's names, once each
    told = F.flatten(F.transform(F.filter(found, lambda e: e["kind"].isin("name", "email")), lambda e: F.when(e["kind"] == "name", name_parts(e["v"])).otherwise(spelled_name(e["v"], F.col("text")))))
    rows = written(rows.withColumn(spoken, F.array_distinct(told)).withColumn(md5, F.md5(F.col("text").cast("binary"))), "pii-rows")
    entities = F.array_union(F.filter(found, lambda e: e["kind"] != "name"), F.col(spoken))
    each = written(rows.select(F.col(md5).alias("md5"), F.explode(entities).alias("e")).select("md5", "e.kind", "e.v").distinct(), "pii-each")
    known = surrogates(each.select("kind", "v").distinct(), key)
    maps = each.join(known, ["kind", "v"]).groupBy("md5").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "v").alias("k"), "s"))).alias(map_))
    of = lambda kind, v: F.element_at(F.col(map_), F.concat_ws(":", kind, v))
    any_given = lambda v: F.coalesce(*[of(F.lit(k), v) for k in ("given female", "given male", "given")])
    changed = rows.join(maps, F.col(md5) == F.col("md5"))

    def filled(e: Column) -> Column:
        word = lambda w: F.when(w["kind"] == "particle", w["v"]).when(w["kind"] == "given", any_given(w["v"])).otherwise(of(w["kind"], w["v"]))
        name = F.concat(lead(e["v"]), F.array_join(F.transform(name_words(e["v"]), word), " "))
        return F.when(e["kind"] == "name", name).otherwise(of(e["kind"], e["v"]))

    def alternatives(kinds, behind: str) -> Column:
        words = F.transform(F.filter(spoken, lambda p: p["kind"].isin(*kinds)), lambda p: F.concat(F.lit(r"\Q"), p["v"], F.lit(r"\E")))
        return F.when(F.size(words) > 0, F.concat(F.lit(r"(?:"), F.array_join(F.array_distinct(words), "|"), F.lit(rf"){behind}")))

    # columns of their own, made before the texts are cut: below they stand within a function of each part of a text
    before = rf"(?<![\p{{L}}\p{{M}}'’-])(?<!(?<![\p{{L}}\p{{M}}]){_ARTICLE} )"
    words = F.concat_ws("|", alternatives(("given", "given male", "given female"), r"(?= \p{Lu})"), alternatives(("family",), r"(?![\p{L}\p{M}'’-])"))
    changed = changed.withColumn(spoken, F.when(words != "", F.concat(F.lit(f"{before}(?:"), words, F.lit(")"))))

    def untitled(part: Column) -> Column:
        """The parts between a text's own names, and their surrogates, by turns."""
        said = F.transform(F.regexp_extract_all(part, F.col(spoken), F.lit(0)), lambda w: F.coalesce(of(F.lit("family"), w), any_given(w)))
        return F.array_join(F.zip_with(F.split(part, F.col(spoken)), F.array_append(said, F.lit("")), lambda p, s: F.concat(p, s)), "")

    parts = F.split("text", PATTERN)
    plain = F.when(F.col(spoken).isNotNull(), F.transform(parts, untitled)).otherwise(parts)
    text = F.array_join(F.zip_with(plain, F.array_append(F.transform(found, filled), F.lit("")), lambda p, s: F.concat(p, s)), "")
    changed = changed.select(*[text.alias("text") if c == "text" else F.col(c) for c in kept], F.size(found).alias("n_entities"))
    return d.where(~with_any).withColumn("n_entities", F.lit(0)).unionByName(changed)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source", "n_chars", "n_entities")
