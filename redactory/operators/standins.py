"""Stand-ins by rank, for values whose draws are taken: another for each rank, and plausible.

Each type has a space of values beside those that are drawn (other names, other number formats), of size a * b. The rank of
a value in its type goes through a keyed Feistel network over pairs (left < a, right < b), which is a permutation of the
space, so neighbouring ranks look unlike and no two meet. Ranks beyond the space take its next level, which shows in the
value: a second surname, an extension, a unit.
"""

from __future__ import annotations

#: Starts and ends that given names and surnames are made of; no start is the beginning of another.
_GIVEN = ("Al Bel Cor Dar El Fen Gar Hal Is Jor Kel Lor Mar Nor Or Per Quin Ros Sel Tam Ul Ver Wil Yor Zel".split(), "a an en ie in ina is ith on or ora us wen win yn y".split())
_SURNAME = (
    "Ash Bar Brad Cal Cor Dal Den Dun Eas Edg Fair Farn Gal Glen Hal Ham Hart Hol Ing Jar Kel Ken Kin Lang Lar Lin Lock Mal Mar Mel Mil Nor Oak Old Os Pen Per Pil Quin Rad Ran Red Rock Ros Ruth San Sel Shir Stan Stav Sut Tan Thorn Til Up Val Wal Wen Whit Wyn".split(),
    "ton ley ford wood field worth ham well shaw more land by combe wick stead bourne brook dale den don er gate grove hurst in ing kirk lock mead mere mond mouth ner ney over pool port ridge row sby sham side stock stone thorpe ville ward way win wyn".split(),
)
_DOMAINS, _MONTHS = ["placeholder.com", "example.com.au", "sample.net"], "January February March April May June July August September October November December".split()
_STREETS = [s + e for s in ("Ash", "Birch", "Cedar", "Fern", "Heath", "Laurel", "Moss", "Rose", "Thorn", "Vine") for e in (" Hill", " Park", "brook", "dale")]
_TOWNS = ["Ballarat", "Bendigo", "Bunbury", "Dubbo", "Gosford", "Mackay", "Nowra", "Orange", "Tamworth", "Wagga Wagga"]
_GIVENS, _SURNAMES = len(_GIVEN[0]) * len(_GIVEN[1]), len(_SURNAME[0]) * len(_SURNAME[1])
#: The two factors of each type's space.
SPACES = {
    "NAME_PII": (_GIVENS, _SURNAMES), "EMAIL": (_GIVENS, _SURNAMES * len(_DOMAINS)), "PHONE": (10**4, 10**4), "CREDIT_CARD": (10**7, 10**7), "MEDICARE": (10**4, 10**5), "TFN": (10**4, 10**5), "ACN": (10**4, 10**5),
    "ABN": (10**5, 10**6), "PASSPORT": (26 * 26, 10**7), "LICENCE": (26, 10**8), "BSB": (10**3, 10**3), "BANK_ACCOUNT": (10**5, 10**5), "DOB": (28 * 12, 105), "GPS": (4 * 10**6, 7 * 10**6), "MONEY": (10**4, 10**5),
    "ADDRESS": (len(_STREETS) * len(_TOWNS), 200 * 50),
}
ROUNDS = 6


def _of_type(values: dict[str, object]) -> str:
    return "(CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 1 END)"


def spaces(d) -> dict[str, str]:
    """Columns over type and rank (a BIGINT from 0): the factors, the level, and the two halves to be permuted."""
    return {"fa": f"CAST({_of_type({k: a for k, (a, _) in SPACES.items()})} AS BIGINT)", "fb": f"CAST({_of_type({k: b for k, (_, b) in SPACES.items()})} AS BIGINT)"}


def permuted(d) -> str:
    """[left, right] after the rounds, over type, rank, fa and fb. Each round adds to one half a number that the other half decides."""
    x = f"({d.at_list('h', 1)})", f"({d.at_list('h', 2)})"
    level = d.string(d.div("rank", "(fa * fb)"))
    number = lambda half: d.hash32(f"concat(type, ':', {level}, ':', {d.string('i')}, ':', {d.string(half)})")
    step = f"CASE WHEN i % 2 = 1 THEN {d.array(f'({x[0]} + {number(x[1])}) % fa', x[1])} ELSE {d.array(x[0], f'({x[1]} + {number(x[0])}) % fb')} END"
    start = d.array(d.div("rank % (fa * fb)", "fb"), "rank % fb")
    return d.fold(d.count_to(ROUNDS), start, "h", "i", step)


def _glued(d, parts, i: str) -> str:
    first, last = parts
    return f"concat({d.pick(first, d.div(i, str(len(last))))}, {d.pick(last, i)})"


def ranked(d) -> str:
    """The stand-in over columns type, l and r (the permuted halves) and lv (the level)."""
    more = lambda text: f"(CASE WHEN lv > 0 THEN {text} ELSE '' END)"
    level = d.string("lv")
    surname = f"concat({_glued(d, _SURNAME, 'r')}, {more(f'concat({chr(39)}-{chr(39)}, {_glued(d, _SURNAME, "(lv - 1)")})')})"
    cut = lambda s, *spans: ", ".join(f"substring({s}, {a}, {n})" if isinstance(a, int) else a for a, n in spans)
    nine = f"concat({d.pad('l', 4)}, {d.pad('r', 5)})"
    eleven = f"concat({d.pad('l', 5)}, {d.pad('r', 6)})"
    body = f"concat('5', {d.pad('l', 7)}, {d.pad('r', 7)})"
    digit = lambda i: f"CAST(substring({body}, {i}, 1) AS INT)"
    total = " + ".join(f"(({digit(i)} * 2) % 10 + {d.div(f'{digit(i)} * 2', '10')})" if i % 2 else digit(i) for i in range(1, 16))
    card = f"concat({body}, {d.string(f'(10 - ({total}) % 10) % 10')})"
    suffix = more(f"concat(' ext ', {level})")
    letter = lambda i: f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST({i} AS INT) + 1, 1)"
    thousand = f"({d.div('(l * 100000 + r)', '100')} + 1000)"
    grouped = f"format_number({thousand}, 0)" if d.name == "spark" else f"format('{{:,}}', {thousand})"
    street = f"concat({d.string('r % 200 + 1')}, ' ', {d.pick(_STREETS, d.div('l', str(len(_TOWNS))))}, ' Lane ', {d.pick(_TOWNS, 'l')})"
    cases = {
        "NAME_PII": f"concat({_glued(d, _GIVEN, 'l')}, ' ', {surname})",
        "EMAIL": f"concat(lower({_glued(d, _GIVEN, 'l')}), '.', lower({_glued(d, _SURNAME, d.div('r', str(len(_DOMAINS))))}), {more(level)}, '@', {d.pick(_DOMAINS, 'r')})",
        "PHONE": f"concat('02 ', {d.pad('l', 4)}, ' ', {d.pad('r', 4)}, {suffix})",
        "CREDIT_CARD": f"concat({cut(card, (1, 4), (chr(39) + ' ' + chr(39), 0), (5, 4), (chr(39) + ' ' + chr(39), 0), (9, 4), (chr(39) + ' ' + chr(39), 0), (13, 4))}, {suffix})",
        "MEDICARE": f"concat('3', {cut(nine, (1, 3))}, ' ', {cut(nine, (4, 5))}, ' ', {cut(nine, (9, 1))}, {suffix})",
        "TFN": f"concat({cut(nine, (1, 3))}, '-', {cut(nine, (4, 3))}, '-', {cut(nine, (7, 3))}, {suffix})",
        "ACN": f"concat('ACN ', {cut(nine, (1, 3))}, ' ', {cut(nine, (4, 3))}, ' ', {cut(nine, (7, 3))}, {suffix})",
        "ABN": f"concat({cut(eleven, (1, 2))}, '-', {cut(eleven, (3, 3))}, '-', {cut(eleven, (6, 3))}, '-', {cut(eleven, (9, 3))}, {suffix})",
        "PASSPORT": f"concat({letter(d.div('l', '26'))}, {letter('l % 26')}, {d.pad('r', 7)}, {suffix})",
        "LICENCE": f"concat({letter('l')}, {d.pad('r', 8)}, {suffix})",
        "BSB": f"concat({d.pad('l', 3)}, ' ', {d.pad('r', 3)}, {suffix})",
        "BANK_ACCOUNT": f"concat({d.pad('l', 5)}, '-', {d.pad('r', 5)}, {suffix})",
        "DOB": f"concat({d.string('l % 28 + 1')}, ' ', {d.pick(_MONTHS, d.div('l', '28'))}, ' ', {d.string('r + 1900')}, {more(f'concat({chr(39)}, {chr(39)}, {d.pad(d.div("lv", "60"), 2)}, {chr(39)}:{chr(39)}, {d.pad("lv % 60", 2)})')})",
        "GPS": f"concat('-', {d.string(d.div('l', '1000000') + ' + 33')}, '.', {d.pad('l % 1000000', 6)}, ', ', {d.string(d.div('r', '1000000') + ' + 144')}, '.', {d.pad('r % 1000000', 6)}, {suffix})",
        "MONEY": f"concat('$', {grouped}, '.', {d.pad('r % 100', 2)}, {suffix})",
        "ADDRESS": f"concat({d.string('(r // 200) + 1' if d.name == 'duck' else '(r div 200) + 1 ')}, '/', {street}, {more(f'concat({chr(39)} Level {chr(39)}, {level})')})",
    }
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + f" ELSE concat('[redacted ', {d.string('rank + 1')}, ']') END"
