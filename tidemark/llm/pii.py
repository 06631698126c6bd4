"""Keyed surrogates for personal data, in DataFrame and SQL functions only.

Entities (e-mail addresses, IPv4 addresses, phone numbers, Luhn-valid card numbers, IBANs, US social security numbers,
quoted or bare hexadecimal secrets and titled names) get a replacement of their own type and format that a key fixes:
digits for digits, letters for letters of the same script and case, separators as they are, octets in range, card check
digits valid, top-level domains kept, names of the title's gender in the name's script. One entity has one surrogate
wherever and however it is spelled (case, separators); different entities have different ones. Cards are sought in whole
runs of digits and in their parts of up to five groups, the most in which cards are printed. A titled name is also found
without its title and by its surname in the same document; a surname there stands for the first full name that has it.

Surrogates follow from the entity, so documents are rewritten map-side without a join. A pre-aggregated table of distinct
entities finds collisions (two entities with one surrogate, or a surrogate that is itself an entity here); the later one
takes its next surrogate until none is left, and only documents with such an entity are joined.

Defined results: null and empty texts stay as they are with no entities; repeated rows get equal texts; an empty table
gives an empty result; other columns are ignored; formats that are used up are as `exceptions` says.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Titles and their gender; fixed values.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "κα")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ")
NEUTRAL = ("Dr", "Prof")
#: Given names by script and gender; fixed values.
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Ines Julia Laura Marta Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Marco Oscar Paul Victor",
    ("latin", "n"): "Alex Andrea Charlie Dana Kim Robin Sascha Toni",
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Софья",
    ("cyrillic", "m"): "Антон Борис Иван Игорь Лев Олег Павел Юрий",
    ("cyrillic", "n"): "Саша Женя Валя Слава",
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία",
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Στέφανος Χρήστος",
    ("greek", "n"): "Αλέξις Άρης",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va vi",
    "cyrillic": "ба бе бо ва ве ви го да де до ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са со та те ти то",
    "greek": "βα γο δα δε κα κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε τα τε τι το",
}
_TITLES = "|".join(sorted((*FEMALE, *MALE, *NEUTRAL), key=len, reverse=True))
#: What is found, in the order in which types are told apart.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\p{N})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}-\d{4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
#: A run of digit groups, none after the first the start of another entity; possessive, as Java's stack is short.
_GROUP = r"\d++(?![\p{L}\p{N}]|-(?!\d++(?![\p{L}\p{N}])))"
_OTHER = "|".join(f"(?:{PATTERNS[t]})" for t in ("email", "secret", "ip", "ssn", "phone"))
PATTERNS["card"] = rf"(?<![\p{{L}}\p{{N}}.-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:(?: (?!{_OTHER})|-){_GROUP})*+(?![\p{{L}}\p{{N}}-])"
#: Groupings in which cards are usually written; these come before other parts of a run.
_USUAL = r"^(?:\d+|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})$"
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Rows without any of these characters or titles hold no entity; one cheap scan tells.
MAYBE = rf"@|\d|[0-9a-fA-F]{{32}}|(?:{_TITLES})\.? \p{{Lu}}"
_LATIN, _ACCENT, _CYRILLIC, _GREEK = "abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëìíîïñòóôöùúûü", "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _q(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"'


def _luhn(digits: str) -> str:
    """Whether a string of digits has a valid check digit, as SQL."""
    return f"(aggregate(transform(reverse(split({digits}, '')), (c, i) -> CASE WHEN i % 2 = 0 THEN cast(c AS int) ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(c AS int) + 1) END), 0, (s, x) -> s + x) % 10 = 0)"


def _mod97(s: str) -> str:
    """The remainder by 97 of digits and capitals (A is 10), as SQL."""
    return f"aggregate(split({s}, ''), 0, (a, c) -> if(c BETWEEN '0' AND '9', (a * 10 + cast(c AS int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _subkeys(key: str) -> tuple[str, str]:
    """The inner and outer pads of HMAC-SHA256 as hexadecimal text: all that plans show of the key."""
    raw = key.encode() if len(key.encode()) <= 64 else hashlib.sha256(key.encode()).digest()
    raw = raw.ljust(64, b"\0")
    return tuple(hashlib.sha256(bytes(b ^ pad for b in raw)).hexdigest() for pad in (0x36, 0x5C))


def _mac(key: str, message: str) -> str:
    """A keyed hash of an SQL string, with the nesting of HMAC."""
    inner, outer = _subkeys(key)
    return f"sha2(concat('{outer}', sha2(concat('{inner}', {message}), 256)), 256)"


def entity_type(v: str) -> str:
    """The type of a match; a run of digits may hold cards, what else there is are names without title."""
    cases = " ".join(f"WHEN {v} RLIKE {_q('^(?:' + p + ')$')} THEN '{t}'" for t, p in PATTERNS.items() if t != "card")
    return f"(CASE {cases} WHEN {v} RLIKE '^[0-9]' THEN 'run' ELSE 'name' END)"


def cards(v: str) -> str:
    """The pieces (v, t) of a run of digits: its Luhn-valid cards, and what lies between them without a type."""
    groups = f"regexp_extract_all({v}, '[0-9]+[ -]?', 0)"
    text = "regexp_replace(array_join(slice(w.g, i + 1, k), ''), '[ -]$', '')"
    digits = "regexp_replace(x.c, '[^0-9]', '')"
    parts = f"flatten(transform(w.g, (y, i) -> transform(sequence(1, least(5, size(w.g) - i)), k -> named_struct('i', i, 'k', k, 'c', {text}))))"
    # the whole run may have more groups
    whole = f"array(named_struct('i', 0, 'k', size(w.g), 'c', {v}))"
    valid = f"filter(concat({whole}, {parts}), x -> length({digits}) BETWEEN 13 AND 19 AND {_luhn(digits)})"
    order = f"array_sort(transform({valid}, x -> named_struct('o', CASE WHEN x.k = size(w.g) THEN 0 WHEN x.c RLIKE {_q(_USUAL)} THEN 1 ELSE 2 END, 'i', x.i, 'e', -x.k, 'c', x.c)))"
    taken = f"aggregate({order}, filter({order}, z -> false), (a, z) -> if(exists(a, b -> b.i < z.i - z.e AND z.i < b.i - b.e), a, concat(a, array(z))))"
    inside = "exists(w.a, b -> b.i < i AND i < b.i - b.e)"
    card = "element_at(filter(w.a, b -> b.i = i), 1)"
    last = "regexp_extract(y, '[ -]?$', 0)"
    plain = "named_struct('v', {0}, 't', CAST(NULL AS string))"
    end = f"regexp_extract(element_at(w.g, {card}.i - {card}.e), '[ -]?$', 0)"
    piece = f"CASE WHEN {inside} THEN filter(array({plain.format('y')}), z -> false) WHEN exists(w.a, b -> b.i = i) THEN array(named_struct('v', {card}.c, 't', 'card'), {plain.format(end)}) ELSE array({plain.format('y')}) END"
    step = f"transform(array(named_struct('g', {groups})), w -> named_struct('g', w.g, 'a', {taken}))"
    return f"flatten(transform({step}, w -> flatten(transform(w.g, (y, i) -> {piece}))))"


_GENDER = lambda v: f"CASE WHEN {v} RLIKE {_q('^(' + '|'.join(FEMALE) + ')[. ]')} THEN 'f' WHEN {v} RLIKE {_q('^(' + '|'.join(MALE) + ')[. ]')} THEN 'm' ELSE 'n' END"
_TITLE = "^(?:" + _TITLES + r")\.? "
_TAIL = "(?:'s|['-]+)$"
_BARE = lambda v: f"regexp_replace(regexp_replace({v}, {_q(_TITLE)}, ''), {_q(_TAIL)}, '')"


def people() -> str:
    """The titled names of a text (b, g, w as written), full names first; a title without gender takes that of the same name."""
    raw = f"transform(CASE WHEN text RLIKE {_q(PATTERNS['name'])} THEN regexp_extract_all(text, {_q(PATTERNS['name'])}, 0) ELSE array() END, v -> named_struct('b', lower({_BARE('v')}), 'g', {_GENDER('v')}, 'w', {_BARE('v')}))"
    known = "coalesce(element_at(filter(w.p, q -> q.b = p.b AND q.g <> 'n'), 1).g, 'n')"
    each = f"transform(w.p, p -> named_struct('b', p.b, 'g', if(p.g = 'n', {known}, p.g), 'w', p.w))"
    all_ = f"flatten(transform(array(named_struct('p', array_distinct({raw}))), w -> array_distinct({each})))"
    return f"flatten(transform(array(named_struct('p', {all_})), w -> concat(filter(w.p, p -> p.b LIKE '% %'), filter(w.p, p -> NOT p.b LIKE '% %'))))"


def own_pattern() -> str:
    """The pattern of a text with titled names: these names and their surnames count without a title too."""
    spelled = "flatten(transform(people, p -> array(p.w, upper(p.w), substring_index(p.w, ' ', -1), upper(substring_index(p.w, ' ', -1)))))"
    ordered = f"array_sort(array_distinct({spelled}), (a, b) -> if(length(a) = length(b), 0, length(b) - length(a)))"
    names = f"replace(array_join({ordered}, '|'), ' ', {_q(chr(92) + 's+')})"
    return f"concat({_q(PATTERN + '|(?<!' + chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}])(?:')}, {names}, {_q(')(?!' + chr(91) + chr(92) + 'p{L}' + chr(92) + 'p{N}])')})"


def normal(t: str, v: str) -> str:
    """What is the same entity however spelled; one character for each that the surrogate replaces; a name as its document knows it."""
    bare = rf"regexp_replace(lower({_BARE(v)}), r'\s+', ' ')"
    fits = f"(p.b = {bare} OR endswith(p.b, concat(' ', {bare}))) AND ({_GENDER(v)} = 'n' OR p.g = 'n' OR p.g = {_GENDER(v)})"
    person = f"coalesce(element_at(transform(filter(people, p -> {fits}), p -> concat(p.g, '|', p.b)), 1), concat({_GENDER(v)}, '|', {bare}))"
    return f"(CASE WHEN {t} IN ('phone', 'card', 'ssn') THEN concat(if(left({v}, 1) = '+', '+', ''), regexp_replace({v}, '[^0-9]', '')) WHEN {t} = 'iban' THEN replace({v}, ' ', '') WHEN {t} = 'name' THEN {person} ELSE lower({v}) END)"


def _byte(h: str, i: str) -> str:
    return f"cast(conv(substr({h}, 2 * (({i}) % 64) + 1, 2), 16, 10) AS int)"


def _letters(s: str, h: str) -> str:
    """Each character's counterpart of its own kind."""
    pick = lambda a: f"substr('{a}', {_byte(h, 'i')} % {len(a)} + 1, 1)"
    kinds = [("[0-9]", "0123456789"), ("[a-z]", _LATIN), ("[A-Z]", _LATIN.upper()), (f"[{_CYRILLIC}ё]", _CYRILLIC), (f"[{_GREEK}ά-ώς]", _GREEK), (r"\p{IsLatin}", _ACCENT)]
    return f"array_join(transform(split({s}, ''), (c, i) -> CASE {' '.join(f'WHEN c RLIKE {_q(k)} THEN {pick(a)}' for k, a in kinds)} ELSE c END), '')"


def surrogate(t: str, n: str, attempt: str, key: str) -> str:
    """The surrogate of a normal form, itself in normal form (a name: as it is written)."""
    message = lambda part: f"concat('{part}|', {t}, '|', {n}, '|', {attempt})"
    # bound once as mac: spelled out wherever a byte is taken, they would multiply the plan and the work
    hashes = f"concat({_mac(key, message('a'))}, {_mac(key, message('b'))})"
    domain = f"substring_index({n}, '@', -1)"
    host = f"left({domain}, length({domain}) - length(substring_index({domain}, '.', -1)))"
    # the domain has a surrogate of its own, so addresses of one domain stay together, but for the rare that find no mailbox there
    of_domain = lambda part: f"concat('{part}|', {domain}, if({attempt} > 8, concat('|', {attempt}), ''))"
    of_host = f"CASE WHEN {t} = 'email' THEN concat({_mac(key, of_domain('d'))}, {_mac(key, of_domain('e'))}) END"
    h, dh = "mac.h", "mac.d"
    email = f"concat({_letters(f'''substring_index({n}, '@', 1)''', h)}, '@', {_letters(host, dh)}, substring_index({domain}, '.', -1))"
    ip = f"array_join(transform(split({n}, '[.]'), (o, i) -> cast(1 + {_byte(h, 'i')} % 254 AS string)), '.')"
    hexes = f"array_join(transform(split({n}, ''), (c, i) -> substr('0123456789abcdef', {_byte(h, 'i')} % 16 + 1, 1)), '')"
    body = f"concat(left({n}, 1), {_letters(f'substr({n}, 2, length({n}) - 2)', h)})"
    card = f"element_at(filter(transform(sequence(0, 9), z -> concat({body}, cast(z AS string))), w -> {_luhn('w')}), 1)"
    phone = f"concat(regexp_extract({n}, '^(\\\\+1|\\\\+[0-9]{{2}}|)', 1), {_letters(f'''regexp_replace({n}, '^(\\\\\\\\+1|\\\\\\\\+[0-9]{{{{2}}}})', '')'''.replace('{{', '{').replace('}}', '}'), h)})"
    account = _letters(f"substr({n}, 5)", h)
    iban = f"element_at(transform(array({account}), w -> concat(left({n}, 2), lpad(cast(98 - {_mod97(f"concat(w, left({n}, 2), '00')")} AS string), 2, '0'), w)), 1)"
    script = f"CASE WHEN {n} RLIKE '[а-яё]' THEN 'cyrillic' WHEN {n} RLIKE '[α-ωά-ώ]' THEN 'greek' ELSE 'latin' END"
    choose = lambda names, k: f"element_at(split('{names}', ' '), {_byte(h, k)} % {len(names.split())} + 1)"
    given = "CASE " + " ".join(f"WHEN {script} = '{s}' AND left({n}, 1) = '{g}' THEN {choose(names, '0')}" for (s, g), names in GIVEN.items()) + " END"
    # one more syllable with each attempt: there are always enough names
    family = "initcap(CASE " + " ".join(f"WHEN {script} = '{s}' THEN array_join(transform(sequence(1, 4 + {attempt}), (z, k) -> {choose(names, 'z')}), '')" for s, names in SYLLABLES.items()) + " END)"
    name = f"concat(if({n} LIKE '% %', concat({given}, ' '), ''), {family})"
    kinds = f"CASE {t} WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'secret' THEN {hexes} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'iban' THEN {iban} WHEN 'name' THEN {name} ELSE {_letters(n, h)} END"
    return f"element_at(transform(array(named_struct('h', {hashes}, 'd', {of_host})), mac -> {kinds}), 1)"


def rendered(t: str, v: str, s: str) -> str:
    """The surrogate in the match's own spelling: its separators and case, a name behind its title."""
    keep = r"[^0-9]"
    digits = f"array_join(transform(split({v}, ''), (c, i) -> CASE WHEN c RLIKE '[0-9]' THEN substr(regexp_replace({s}, '{keep}', ''), length(regexp_replace(left({v}, i + 1), '{keep}', '')), 1) ELSE c END), '')"
    spaced = f"array_join(transform(split({v}, ''), (c, i) -> CASE WHEN c = ' ' THEN c ELSE substr({s}, length(replace(left({v}, i + 1), ' ', '')), 1) END), '')"
    cased = f"array_join(transform(split({v}, ''), (c, i) -> CASE WHEN c <> lower(c) THEN upper(substr({s}, i + 1, 1)) ELSE substr({s}, i + 1, 1) END), '')"
    secret = f"CASE WHEN {v} = lower({v}) THEN {s} WHEN {v} = upper({v}) THEN upper({s}) ELSE {cased} END"
    title = f"regexp_extract({v}, {_q(_TITLE)}, 0)"
    # a surname alone gets the surrogate's surname
    bare = _BARE(v)
    name = f"concat(if({bare} RLIKE '[^ ]\\\\s', concat(substring_index({s}, ' ', 1), regexp_extract({bare}, '\\\\s+', 0)), ''), substring_index({s}, ' ', -1))"
    name = f"concat({title}, if({bare} = upper({bare}), upper({name}), {name}), regexp_extract({v}, {_q(_TAIL)}, 0))"
    return f"(CASE WHEN {t} IN ('phone', 'card', 'ssn') THEN {digits} WHEN {t} = 'iban' THEN {spaced} WHEN {t} = 'email' THEN {cased} WHEN {t} = 'secret' THEN {secret} WHEN {t} = 'name' THEN {name} ELSE {s} END)"


def _found(docs: DataFrame) -> DataFrame:
    """Pieces of each text's matches, in order, with their match, type and normal form; a piece without a type is no entity."""
    rows = docs.withColumn("people", F.expr(people())).withColumn("own_pattern", F.expr(f"CASE WHEN size(people) > 0 THEN {own_pattern()} END"))
    hits = f"CASE WHEN own_pattern IS NOT NULL THEN regexp_extract_all(text, own_pattern, 0) WHEN text RLIKE {_q(MAYBE)} THEN regexp_extract_all(text, {_q(PATTERN)}, 0) ELSE array() END"
    typed = F.expr(f"transform(hits, v -> named_struct('v', v, 't', {entity_type('v')}))")
    pieces = F.expr(f"flatten(transform(hits, (h, m) -> transform(CASE WHEN h.t = 'run' THEN {cards('h.v')} ELSE array(h) END, (e, k) -> named_struct('m', m, 'k', k, 'v', e.v, 't', e.t))))")
    named = F.expr(f"transform(hits, e -> named_struct('m', e.m, 'k', e.k, 'v', e.v, 't', e.t, 'n', CASE WHEN e.t IS NOT NULL THEN {normal('e.t', 'e.v')} END))")
    return rows.withColumn("hits", F.expr(hits)).withColumn("hits", typed).withColumn("hits", pieces).withColumn("hits", named)


def exceptions(entities: DataFrame, key: str, most: int = 64) -> DataFrame:
    """(t, n, attempt, s) of the distinct entities whose first surrogate was taken; entities: distinct (t, n).

    An entity that is in collision still after `most` attempts keeps its last surrogate: its format has too few.
    """
    now = written(entities.withColumn("attempt", F.lit(0)).withColumn("s", F.expr(surrogate("t", "n", "attempt", key))), "pii-entities")
    for _ in range(most):
        # names are compared by surname, as that may stand alone
        now_c = now.withColumn("s", F.when(F.col("t") == "name", F.lower(F.substring_index("s", " ", -1))).otherwise(F.col("s")))
        forms = now.select("t", F.when(F.col("t") == "name", F.substring_index(F.substring_index("n", "|", -1), " ", -1)).otherwise(F.col("n")).alias("s"))
        twice = now_c.groupBy("t", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("attempt", "n")).alias("first")).where("c > 1").select("t", "s", F.col("first.n").alias("stays"))
        taken = now_c.join(twice, ["t", "s"]).where("n <> stays").select("t", "n")
        real = now_c.join(forms.distinct(), ["t", "s"], "left_semi").select("t", "n")
        again = written(taken.union(real).distinct(), "pii-collisions")
        if not again.limit(1).count():
            return now.where("attempt > 0")
        moved = now.join(again.withColumn("move", F.lit(1)), ["t", "n"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("move", F.lit(0)))
        now = written(moved.withColumn("s", F.when(F.col("move") == 1, F.expr(surrogate("t", "n", "attempt", key))).otherwise(F.col("s"))).select("t", "n", "attempt", "s"), "pii-entities")
    return now.where("attempt > 0")


def replace_entities(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities (type, surrogate in order of appearance).

    key: a secret; where it isn't given, the session's setting spark.tidemark.pii.key, and a public one without that.
    """
    key = key or docs.sparkSession.conf.get("spark.tidemark.pii.key", None) or "tidemark"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _found(rows)
    entities = found.where("exists(hits, e -> e.t IS NOT NULL)").select(F.explode(F.expr("filter(hits, e -> e.t IS NOT NULL)")).alias("e")).select("e.t", "e.n").distinct()
    odd = exceptions(entities, key)
    first = surrogate("e.t", "e.n", "0", key)
    if not odd.limit(1).count():
        return _rewritten(found, first)
    # documents with an exceptional entity carry a map of their own exceptions
    row = found.withColumn("row", F.monotonically_increasing_id())
    found = written(row.where("exists(hits, e -> e.t IS NOT NULL)"), "pii-found")
    used = found.select("row", F.explode("hits").alias("e")).select("row", "e.t", "e.n").distinct().join(odd.select("t", "n", "s"), ["t", "n"])
    maps = used.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "t", "n"), "s"))).alias("own"))
    with_maps = found.join(maps, "row", "left").select("doc_id", "text", "own_pattern", "hits", "own")
    chosen = f"coalesce(element_at(own, concat(e.t, '|', e.n)), {first})"
    done = _rewritten(with_maps, chosen)
    plain = _found(rows).where("NOT exists(hits, e -> e.t IS NOT NULL)")
    return done.union(_rewritten(plain, "CAST(NULL AS string)"))


def replacements(chosen: str) -> str:
    """What stands for each of a text's hits, as SQL; chosen: the surrogate of an entity e, which stands there once only."""
    bound = f"transform(hits, e -> named_struct('t', e.t, 'v', e.v, 's', CASE WHEN e.t IS NOT NULL THEN {chosen} END))"
    return f"transform({bound}, e -> coalesce(CASE WHEN e.t IS NOT NULL THEN {rendered('e.t', 'e.v', 'e.s')} END, e.v))"


def _rewritten(found: DataFrame, chosen: str) -> DataFrame:
    out = found.withColumn("to", F.expr(replacements(chosen)))
    between = F.expr(f"CASE WHEN own_pattern IS NOT NULL THEN split(text, own_pattern, -1) ELSE split(text, {_q(PATTERN)}, -1) END")
    out = out.withColumn("parts", F.when(F.size("hits") > 0, between))
    text = F.expr("CASE WHEN size(hits) = 0 THEN text ELSE concat(array_join(transform(hits, (e, i) -> concat(if(e.k = 0, parts[e.m], ''), to[i])), ''), element_at(parts, -1)) END")
    entities = F.expr("filter(transform(hits, (e, i) -> named_struct('type', e.t, 'surrogate', to[i])), x -> x.type IS NOT NULL)")
    return out.select("doc_id", text.alias("text"), F.expr("cast(size(filter(hits, e -> e.t IS NOT NULL)) AS bigint)").alias("n_entities"), entities.alias("entities"))


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
