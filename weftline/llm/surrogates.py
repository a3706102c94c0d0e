"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

A surrogate is a keyed permutation of all values of the entity's format (a Feistel network over
the format's numbers, walked until the result has the format again): digits stay digits,
letters stay letters of their script and case, separators stay, card numbers keep their
issuer's digit and whether their check digit is right, addresses stay addresses that are not
reserved, given names stay names of their gender and script. So equal entities get equal
surrogates everywhere, and different ones different surrogates. Cards, phones and IBANs are equal
if their signs are, however spaced, addresses if they are but for case; a surrogate is written as
the mention is. A given or family name that follows a full name in its text gets that name's part.

Names are a given name of ``GIVEN_NAMES``, a blank and a capitalised word, or one or two capitalised
words after a title or a phrase that introduces a person; other names are not seen. A given name
that is in no list is replaced by letters of its script.

A surrogate could still be a value that somebody else in the corpus has. The entities of the
whole corpus are therefore gathered as a distinct table; an entity whose surrogate is one of
them gets another from a permutation with another key, and so on until its surrogate is neither
an entity nor the surrogate of another: different values stay different. Where a format is so
full that ``most_rounds`` keys gave none, mails and names get a longer one, one sign more in each
further round, and other kinds a keyed mark such as ``[ssn 0f3a...]``. Texts are rewritten where
they are; only texts with such an entity meet the (short) list of exceptions.

Defined cases: null stays null, empty stays empty; a text without entities stays as it is; null
and repeated ids are rewritten like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, drop_written, slices, written

#: Given names by script and gender; a name is replaced by another of its list.
GIVEN_NAMES: dict[tuple[str, str], tuple[str, ...]] = {
    ("latin", "female"): tuple("Agnes Alice Amelia Amy Ana Andrea Angela Anna Anne Barbara Beatriz Birgit Camille Carla Carmen Caroline Catherine Charlotte Chloé Christine Clara Claire Claudia Cristina Diana Dorothy Elena Elisabeth Elizabeth Emily Emma Eva Françoise Gabriele Hannah Heike Helen Helena Inès Ingrid Isabel Isabelle Jennifer Jessica Joanna Julia Julie Karen Karin Katharina Laura Léa Linda Lisa Lucía Lucy Manon Margaret Maria María Marie Marta Martina Mary Michelle Monika Mónica Nancy Nicole Nora Olivia Patricia Paula Petra Pilar Rachel Rebecca Rosa Ruth Sabine Sandra Sara Sarah Silvia Sofia Sofía Sophie Stefanie Susan Susanne Sylvie Teresa Ursula Valérie Victoria".split()),
    ("latin", "male"): tuple("Adam Alain Alan Alberto Alejandro Alexander Andreas Andrew Ángel Anthony Antoine Antonio Benjamin Bernd Brian Carlos Charles Christian Christopher Daniel David Diego Dieter Edward Enrique Eric Erik Felix Fernando Francisco Franz François Frank Frédéric George Gérard Günter Hans Heinrich Henry Hugo Ivan Jack Jacques James Jan Javier Jean Jens Jérôme Johannes John Jonas Jorge José Joseph Juan Julien Jürgen Karl Kevin Klaus Kurt Louis Lucas Luis Manuel Marc Marcel Mario Mark Martin Matthew Max Michael Michel Miguel Nicolas Olivier Oscar Otto Pablo Patrick Paul Pedro Peter Philippe Pierre Rafael Ralf Ramón Raúl Richard Robert Roberto Sebastian Sergio Simon Stefan Stephen Steven Thomas Uwe Werner William Wolfgang Yves".split()),
    ("cyrillic", "female"): tuple("Александра Алёна Алина Алла Анастасия Анна Валентина Вера Виктория Галина Дарья Евгения Екатерина Елена Зоя Инна Ирина Ксения Лариса Людмила Марина Мария Надежда Наталья Нина Оксана Ольга Полина Светлана София Тамара Татьяна Юлия".split()),
    ("cyrillic", "male"): tuple("Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валерий Василий Виктор Владимир Георгий Григорий Денис Дмитрий Евгений Егор Иван Игорь Кирилл Константин Максим Михаил Николай Олег Павел Пётр Роман Семён Сергей Степан Фёдор Юрий".split()),
}
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ", "ёєіїґ", "ЁЄІЇҐ")
_CLASS = {c: a for a in _ALPHABETS for c in a}

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_NUMERIC = re.compile(
    r"(?<![\w.])(?:(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?![\w]|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7})(?![\w-])"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|\+\d{8,14})(?!\w))|(?<=\s)(?P<phone2>\(\d{3}\) ?\d{3}[ .-]\d{4})(?!\w)"
)
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_ACCESS_KEY = re.compile(r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b")
_SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key)\b["']?\s*[:=]\s*["']([^"'\s]{6,})["']""", re.I)
_HEX = re.compile(r"[0-9a-f]{8,}")
_GIVEN = frozenset(n for names in GIVEN_NAMES.values() for n in names)
_UPPER = "A-ZÀ-ÖØ-ÞŒĆČĐĞİŁŃŐŘŚŞŠŰŹŻŽА-ЯЁЄІЇҐ"
#: A capitalised word, and ahead of it a family name: letters of any kind, hyphens, apostrophes.
_NAME = re.compile(rf"\b([{_UPPER}][^\W\d_]+)(?= ([{_UPPER}](?:['’][{_UPPER}])?[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*))")
_WORD = rf"[{_UPPER}](?:['’][{_UPPER}])?[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*"
#: What comes before a person's name.
_BEFORE = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Señora", "Sra", "my name is", "My name is", "Contact", "contact", "Author:", "Name:", "Signed,", "Regards,")
_INTRODUCED = re.compile(rf"\b(?:{'|'.join(_BEFORE)})\.? ({_WORD}(?: {_WORD})?)")
_PART = re.compile(rf"\b[{_UPPER}](?:['’][{_UPPER}])?[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*")


class Permutation:
    """A keyed bijection of the integers below ``size``."""

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)

    def _round(self, i: int, x: int) -> int:
        digest = hmac.new(self.key, b"%s|%d|%d" % (self.label, i, x), hashlib.sha256).digest()
        return int.from_bytes(digest, "big") & ((1 << self.half) - 1) if self.half <= 256 else int.from_bytes(hashlib.shake_256(digest).digest(self.half // 8 + 1), "big") & ((1 << self.half) - 1)

    def __call__(self, x: int) -> int:
        if self.size < 2:
            return x
        while True:
            left, right = x >> self.half, x & ((1 << self.half) - 1)
            for i in range(8):
                left, right = right, left ^ self._round(i, right)
            x = left << self.half | right
            if x < self.size:
                return x


def permuted_format(key: bytes, kind: str, text: str, fixed: Callable[[int, str], bool] = lambda i, c: False) -> str:
    """A text of the same format: characters of the known alphabets change within their alphabet, others stay."""
    at = [i for i, c in enumerate(text) if c in _CLASS and not fixed(i, c)]
    size, number = 1, 0
    for i in at:
        alphabet = _CLASS[text[i]]
        number, size = number * len(alphabet) + alphabet.index(text[i]), size * len(alphabet)
    shape = "".join(c if i not in set(at) else str(_ALPHABETS.index(_CLASS[c])) for i, c in enumerate(text)) + f"|{at}"
    number, out = Permutation(key, f"{kind}|{shape}", size)(number), list(text)
    for i in reversed(at):
        alphabet = _CLASS[text[i]]
        number, k = divmod(number, len(alphabet))
        out[i] = alphabet[k]
    return "".join(out)


def _walk(step: Callable[[str], str], good: Callable[[str], bool], x: str) -> str:
    """The next value on the permutation's cycle that is good; x itself must be."""
    while True:
        x = step(x)
        if good(x):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def public_address(ip: str) -> bool:
    a, b, *_ = parts = [int(p) for p in ip.split(".")]
    plain = all(p <= 255 for p in parts) and ".".join(map(str, parts)) == ip
    return plain and 0 < a < 224 and a not in (10, 127) and not (a == 172 and 16 <= b < 32) and (a, b) not in ((192, 168), (169, 254))


def canonical(kind: str, value: str) -> str:
    """What all ways to write an entity have in common."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "phone", "iban"):
        return "+" * value.startswith("+") + "".join(c for c in value if c.isalnum())
    return value


def rendered(kind: str, value: str, mention: str) -> str:
    """A canonical surrogate, written as the mention is."""
    if kind == "email" and len(value) == len(mention):
        return "".join(c.upper() if m.isupper() else c for c, m in zip(value, mention, strict=True))
    if kind in ("card", "phone", "iban") and not value.startswith("["):
        signs = iter(value.removeprefix("+"))
        return "".join(next(signs) if c.isalnum() else c for c in mention)
    return value


def longer(kind: str, value: str, key: bytes, more: int) -> str:
    """A surrogate outside the entity's format, which is full: a name or mail ``more`` signs longer, else a mark."""
    if kind == "email":
        return _surrogate(kind, "a" * more + value, key)
    if kind == "name":
        return _surrogate(kind, value + "a" * more, key)
    return f"[{kind} {hmac.new(key, f'{kind}|{value}'.encode(), hashlib.sha256).hexdigest()[:32]}]"


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one mention: that of its canonical form, written alike."""
    return rendered(kind, _surrogate(kind, canonical(kind, value), key), value)


def _surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of a canonical entity: a bijection of the values of its kind and format."""
    if kind == "ip":
        if not public_address(value):
            return value  # tells of nobody
        of = lambda ip: int.from_bytes(bytes(int(p) for p in ip.split(".")), "big")
        permute = Permutation(key, "ip", 1 << 32)
        return _walk(lambda ip: ".".join(map(str, permute(of(ip)).to_bytes(4, "big"))), public_address, value)
    if kind == "card":
        right = luhn(re.sub(r"\D", "", value))
        return _walk(lambda v: permuted_format(key, kind, v, lambda i, c: i == 0), lambda v: luhn(re.sub(r"\D", "", v)) == right, value)
    if kind == "name":
        given, blank, family = value.rpartition(" ")
        for (script, gender), names in GIVEN_NAMES.items():
            if given in names:
                given = names[Permutation(key, f"{script}|{gender}", len(names))(names.index(given))]
                break
        else:
            given = _walk(lambda v: permuted_format(key, "given", v), lambda v: v not in _GIVEN, given) if given else ""
        return f"{given}{blank}{permuted_format(key, 'family', family)}"
    if kind == "email":
        local, _, domain = value.partition("@")
        head, _, top = domain.rpartition(".")
        return f"{permuted_format(key, 'local', local)}@{permuted_format(key, 'domain', head)}.{top}"
    if kind == "secret":
        if _HEX.fullmatch(value):
            return f"{Permutation(key, f'hex|{len(value)}', 16 ** len(value))(int(value, 16)):0{len(value)}x}"
        return _walk(lambda v: permuted_format(key, kind, v), lambda v: not _HEX.fullmatch(v), value)
    fixed = {"access_key": lambda i, c: i < 4, "iban": lambda i, c: i < 2, "phone": lambda i, c: value.startswith("+") and i < 2}.get(kind, lambda i, c: False)
    return permuted_format(key, kind, value, fixed)


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities in a text, in order, without overlaps; the longest at a place counts."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    for m in _NUMERIC.finditer(text):
        kind = m.lastgroup.rstrip("2")
        if kind == "ip" and not all(int(p) <= 255 for p in m["ip"].split(".")):
            continue
        found.append((m.start(), m.end(), kind))
    if "AKIA" in text or "ASIA" in text:
        found += [(m.start(), m.end(), "access_key") for m in _ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret") for m in _SECRET.finditer(text)]
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    found += [(m.start(), m.end(2), "name") for m in _NAME.finditer(text) if m[1] in _GIVEN]
    if any(b in text for b in _BEFORE):
        found += [(m.start(1), m.end(1), "name") for m in _INTRODUCED.finditer(text)]
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def rewritten(text: str, replace: Callable[[str, str], str]) -> tuple[str, list[str]]:
    """(text with replaced entities, their kinds); a part of a name counts where it follows the name."""
    parts, kinds, at, known = [], [], 0, {}

    def part(m):
        if m[0] not in known:
            return m[0]
        kinds.append("name")
        return known[m[0]]

    def between(piece):
        return _PART.sub(part, piece) if known else piece

    for start, end, kind in entities(text):
        value = text[start:end]
        new = known[value] if kind == "name" and value in known else replace(kind, value)
        parts += [between(text[at:start]), new]
        kinds.append(kind)
        if kind == "name":
            known.update(zip(value.split(" ", 1), new.split(" ", 1), strict=True))
        at = end
    return "".join([*parts, between(text[at:])]) if kinds else text, kinds


def _exceptions(rows: DataFrame, key: bytes, most_rounds: int) -> DataFrame:
    """(kind, value, surrogate) of the entities whose first surrogate is an entity of the corpus."""

    def gather(batches):
        step = lru_cache(maxsize=50_000)(lambda k, v: surrogate(k, v, key))
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                seen = {(kind, canonical(kind, t[a:b])) for t in part.column(1).to_pylist() if t for a, b, kind in entities(t)}
                seen = [(k, v, step(k, v)) for k, v in sorted(seen)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in seen], pa.string()) for c in range(3)], names=["kind", "value", "surrogate"])

    def again(turn: int):
        def moved(batches):
            for batch in batches:
                kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                fresh, more = key + b"|%d" % turn, turn - most_rounds
                new = [surrogate(k, v, fresh) if more <= 0 else longer(k, v, fresh, more) for k, v in zip(kinds, values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(new, pa.string())], names=["kind", "value", "surrogate"])

        return moved

    ddl, both = "kind string, value string, surrogate string", ["kind", "surrogate"]
    known = written(arrow_map(rows, gather, ddl).distinct(), "entities")
    # what stands for itself (reserved addresses, formats of one value) is no collision
    real, changed = known.select("kind", F.col("value").alias("surrogate")), known.filter("surrogate <> value")
    open_rows = written(changed.join(real, both, "left_semi").select("kind", "value", "surrogate"), "open")
    taken, done = real.unionByName(changed.join(real, both, "left_anti").select(*both)), None
    turn, old = 0, []
    while open_rows.limit(1).count():
        turn += 1
        moved = written(arrow_map(open_rows, again(turn), ddl), "moved")
        # two formats may get equal longer ones: one of them stays
        lone = moved.groupBy(*both).agg(F.min("value").alias("value")).select("kind", "value", "surrogate")
        free = written(lone.join(taken, both, "left_anti").select("kind", "value", "surrogate"), "free")
        left = written(open_rows.join(free.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        old += [open_rows, moved]
        open_rows, done, taken = left, free if done is None else done.unionByName(free), taken.unionByName(free.select(*both))
    drop_written(*old, open_rows)
    return known.limit(0) if done is None else done


def replace_entities(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", *, most_rounds: int = 8) -> DataFrame:
    """``id_col``, n_entities, kinds (sorted, once each), text: every text with its entities replaced."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    exceptions = _exceptions(rows, key, most_rounds)
    ddl = f"`{id_col}` {kind}, n_entities long, kinds array<string>, text string"

    def rewrite(batches):
        step = lru_cache(maxsize=50_000)(lambda k, v: surrogate(k, v, key))
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                special = part.column(2).to_pylist() if part.num_columns > 2 else [None] * part.num_rows
                out = []
                for text, rules in zip(part.column(1).to_pylist(), special, strict=True):
                    given = {(r["kind"], r["value"]): r["surrogate"] for r in rules or ()}
                    out.append((None, []) if text is None else rewritten(text, lambda k, v, given=given: rendered(k, given.get((k, canonical(k, v))) or step(k, canonical(k, v)), v)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(k) for _, k in out], pa.int64()), pa.array([sorted(set(k)) for _, k in out], pa.list_(pa.string())), pa.array([t for t, _ in out], pa.string())],
                    names=[id_col, "n_entities", "kinds", "text"],
                )

    if not exceptions.limit(1).count():
        return arrow_map(rows, rewrite, ddl)

    def occurrences(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                at = [(t, kind, v) for t in part.column(1).to_pylist() if t for kind, v in {(k, canonical(k, t[a:b])) for a, b, k in entities(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(t.encode("utf-8", "replace")).hexdigest() for t, _, _ in at], pa.string()), pa.array([k for _, k, _ in at], pa.string()), pa.array([v for _, _, v in at], pa.string())], names=["_print", "kind", "value"])

    rules = arrow_map(rows, occurrences, "_print string, kind string, value string").distinct().join(exceptions, ["kind", "value"])
    rules = rules.groupBy("_print").agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias("_rules"))
    joined = rows.withColumn("_print", F.md5(F.col("_text").cast("binary"))).join(rules, "_print", "left")
    return arrow_map(joined.select("_id", "_text", "_rules"), rewrite, ddl)
