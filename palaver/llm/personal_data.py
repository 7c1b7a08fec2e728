"""The labelled table that the random field of ``pii`` is trained on: sentences with their spans, written from patterns and values.

A pattern's slots in braces are filled at random; a slot that names a kind is a span of
it, other slots are outside of any.  About half of the patterns hold only what looks like
personal data and isn't.
"""

from __future__ import annotations

import random
from collections.abc import Callable

KINDS = ("email", "ip", "card", "phone", "secret", "name", "address", "iban", "national_id")
#: Kinds whose spans may be several words.
LONG = ("email", "card", "phone", "name", "address", "iban")

FIRST_NAMES = (
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen "
    "daniel lisa matthew nancy anthony betty mark sandra steven ashley paul emily andrew donna kevin michelle brian carol george amanda peter anna "
    "maria juan carlos luis ana pierre marie jean claude hans klaus ursula wolfgang sabine giulia marco ivan olga chen wei fatima ahmed omar aisha priya raj"
).split()
_LAST_NAMES = "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez wilson anderson taylor moore jackson lee white harris clark lewis walker hall young king wright hill green adams baker nelson carter schmidt fischer weber dubois moreau rossi novak kumar".split()
_STREETS = "oak maple cedar pine elm park lake hill church mill river spring station high king queen garden bridge rose market".split()
STREET_TYPES = "street st road rd avenue ave lane ln drive boulevard blvd way court ct square place terrace close crescent".split()
_TOWNS = "springfield riverside ashford milton burton newport salem dover clifton kingston oxford leeds boston denver austin".split()
_FILLER = "the of and that with from these have been seen where they went over under after again it is as in on by was for a to not were some time people found place work".split()

#: Sentences with personal data.
PATTERNS = (
    "{w} {name} {w} {w}", "my name is {name} {w} {w}", "{W} name is {name}.", "contact {name} at {phone}", "please contact {name}, {address}", "{name}, {address}, {w}",
    "Mr {name} {w} {w} {w}", "Dr. {name} {w} {w}", "Mrs. {name}, {w} {w}", "dear {name}, {w} {w}", "regards, {name}", "signed {name} {w}", "{w} {w} met {name} {w} the {w}",
    "{name} <{email}> {w}", "name: {name}, phone: {phone}", "{name} lives at {address}", "he lives at {address}.", "{w} ship to {address}, {w}", "address: {address}", "send it to {address} {w}",
    "{w} {email} {w}", "mail {email}, {w}", "mail {spelled} {w} {w}", "reach me: {spelled}", "{w} write to {spelled}.", "email {spelled}, {w}", "{w} {w} at {spelled} {w}", "{w} {ip} {w} {w}", "host {ip}: {w}", "{w} {card} {w}", "card {cards} {w}", "paid by {card}, {w}", "visa {cards}.",
    "call {phone} {w}", "{w} {phone} {w} {w}", "tel: {phone}", "phone {local} {w}", "call {local}, {w}", "{w} +1 {area} {rest} {w}",
    "token = \"{code}\" {w}", "{w} key = \"{code}\"", "secret: {code} {w}", "TOKEN = {code}", "password: {password} {w} {w}", "password is {password}, {w}", "passwd={password}", "the password: {password}; {w}", "passphrase: {password} {w}", "api key: {code}", "pwd: {password}", "my password is {password}", "the password is {password} {w} {w}", "{w} {w} the secret is {password}, {w}", "with password {password}, {w}",
    "IBAN {iban} {w}", "iban: {ibans}, {w}", "account {ibans} {w}", "{w} {ibans} {w}", "{w} transfer to {iban}.", "transfer to {ibans} {w} {w}", "SSN {ssn} {w}", "ssn: {ssn}, {w}", "social security number {ssn}", "my SSN is {ssn} {w} {w}", "{w} ssn is {ssn}, {w}", "social security {ssn}, {w}", "{w} {ssn} {w}", "id {ssn}; {w}",
    "{name} {w} {phone} {w} {email}", "{name}, {phone}, {email}", "patient {name}, ssn {ssn}, {address}",
)
#: Sentences without.
PLAIN = (
    "{w} {w} {number} {w} {w}", "{W} {w} {year} {w} {w}", "in {year} {w} {w}, {w} {year}.", "{w} {date} {w} {w}", "version {version} {w}", "{w} {version}, {w} {w}", "{w} {notcard} {w} {w}", "{w} {notip} {w}", "{W} {w}. {W} {w} {number} {w}",
    "{w}. {W} {w} {w} {number} {w}. {W} {w}", "{CAPS}!! {CAPS}!! {number} {w}", "{w}### {W}%%% {notcard}$$$ {w}&&&", "{w} @{w} {w}", "{w}@ {w} {w}", "{w} ({number}) {w}", "{w} {page} {w} {w}", "{local} {w} {w}", "{w} {w} {word}{number} {w}",
    "the password was {w} {w} {w}", "a secret {w} {w} {w} {w}", "token {w} {w} {w}", "forgot password? {W} {w}", "password {w} {w}", "the name of {w} {w} {w}", "{w} name {w} {w}", "{W} {W} {w} {w}", "{w} contact {w} {w} {w}", "dear {w} {w} {w}", "{w} dot {w} {w}", "look at {w} dot {w}", "the key to {w} {w}",
    "{w} {number} people {w} {w}", "{number} {w} {w} {w}", "{w} {number} streets {w}", "on the road {w} {w} {number}", "{W} {w} st {w} {number}", "{w}. {W} {W}, {number} {w}", "{W} {w}, {number} {w} {w}", "GNU General Public License, version {small}.", "Licensed under the {W} License, Version {version}.", "{w} {CAPS} {CAPS} {number}", "call {w} {w} {number}", "phone {w} {w}", "{w} {code32} {w}",
    "Chapter {small}: {W} {w}", "Section {small}. {W} {W} {w}", "{w} account {w} {w} {number}", "{w} id {small} {w}", "{w} {w} {W} {w} {W} {w}", "{W} {w} {w} {date}, {W} {w}", "© {year} {W} {w}", "{w} {number},{number} {w}", "{w} {small}-{small} {w}", "{CAPS} {small}{small} {w}",
    "{prose}", "{prose}", "{nouns}", "{nouns}", "{same}", "{same}", "{prose} {number} {w}",
)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


class _Values:
    """Values for the slots."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def w(self) -> str:
        return self.r.choice(_FILLER)

    def W(self) -> str:  # noqa: N802
        return self.w().title()

    def CAPS(self) -> str:  # noqa: N802
        return self.w().upper()

    def word(self) -> str:
        return self.r.choice(_FILLER)

    def _first(self) -> str:
        if self.r.random() < 0.7:
            return self.r.choice(FIRST_NAMES).title()
        return "".join(self.r.choice("bdfklmnrst") + self.r.choice("aeiou") for _ in range(self.r.randrange(2, 4))).title()

    def name(self) -> str:
        last = self.r.choice(_LAST_NAMES).title()
        middle = self.r.choice(["", "", "", " J.", " " + self.r.choice(FIRST_NAMES).title()])
        return f"{self._first()}{middle} {last}"

    def address(self) -> str:
        kind = self.r.choice(STREET_TYPES).title()
        street = f"{self.r.randrange(1, 2000)} {self.r.choice(_STREETS).title()} {kind}"
        return street + self.r.choice(["", "", f", {self.r.choice(_TOWNS).title()}", f", {self.r.choice(_TOWNS).title()} {self.digits(5)}"])

    def email(self) -> str:
        return f"{self.word()}{self.r.choice(['.', '', '_'])}{self.digits(2)}@{self.word()}{self.r.randrange(9)}.{self.r.choice(['example', 'mail'])}.{self.r.choice(['com', 'org', 'de'])}"

    def spelled(self) -> str:
        made = "".join(self.r.choice("bdfklmnrst") + self.r.choice("aeiou") for _ in range(self.r.randrange(2, 5)))
        local = self.r.choice([self.r.choice(FIRST_NAMES), made, made + self.digits(2), f"{made} dot {self.r.choice(_LAST_NAMES)}"])
        return f"{local} at {self.r.choice(['site', 'example', 'mail', 'post', made[:4]])} dot {self.r.choice(['com', 'org', 'net', 'de'])}"

    def _made(self) -> str:
        return "".join(self.r.choice(["b", "c", "d", "f", "l", "m", "n", "r", "s", "t", "th", "ch", "ñ", "ç", ""]) + self.r.choice("aeiouaeioué") for _ in range(self.r.choice([1, 1, 2, 2, 3, 4, 5, 7])))

    def prose(self, capitals: float = 0.03) -> str:
        """Sentences of made words, among them short ones of several languages."""
        short = "de la le en un el y is am by to at from und der die a be as will may".split()
        out, begins = [], True
        for _ in range(self.r.randrange(5, 12)):
            word = self.r.choice(short) if self.r.random() < 0.4 else self._made()
            mark = self.r.choice(["", "", "", "", "", ",", ".", "."])
            out.append((word.title() if begins or self.r.random() < capitals else word) + mark)
            begins = mark == "."
        return " ".join(out)

    def nouns(self) -> str:
        return self.prose(0.4)

    def same(self) -> str:
        """A word over and over."""
        word = self.r.choice([self._made(), self.w(), self.r.choice(["de", "en", "a", "at", "la"])])
        word = self.r.choice([word, word.title(), word.title(), word.upper()]) + self.r.choice(["", "", ".", ","])
        return " ".join([word] * self.r.randrange(3, 12))

    def ip(self) -> str:
        return ".".join(str(self.r.randrange(256)) for _ in range(4))

    def notip(self) -> str:
        return ".".join(str(self.r.randrange(256, 999)) for _ in range(4))

    def card(self) -> str:
        body = self.r.choice("3456") + self.digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def cards(self) -> str:
        x = self.card()
        return " ".join(x[k : k + 4] for k in range(0, 16, 4))

    def notcard(self) -> str:
        while luhn(x := self.digits(self.r.choice([12, 14, 16, 16, 18]))):
            pass
        return x

    def area(self) -> str:
        return f"({self.digits(3)})"

    def rest(self) -> str:
        return f"{self.digits(3)}-{self.digits(4)}"

    def local(self) -> str:
        return f"{self.area()} {self.rest()}"

    def phone(self) -> str:
        return f"+{self.r.randrange(1, 99)} {self.local()}" if self.r.random() < 0.7 else f"+{self.digits(2)} {self.digits(3)} {self.digits(6)}"

    def code(self) -> str:
        x = "".join(self.r.choice("0123456789abcdef") for _ in range(self.r.choice([32, 40, 40, 64])))
        return x.upper() if self.r.random() < 0.3 else x

    code32 = code

    def password(self) -> str:
        return self.r.choice([
            "".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randrange(9, 18))),
            self.r.choice(_STREETS).title() + self.digits(3) + self.r.choice("!#$"),
            "".join(self.r.choice("abcdefgABCDEFG0123456789$!%") for _ in range(self.r.randrange(8, 15))),
        ])

    def iban(self) -> str:
        return f"{self.r.choice(['DE', 'GB', 'FR', 'ES', 'IT', 'NL'])}{self.digits(2)}{self.r.choice(['', 'BANK', 'WEST'])}{self.digits(self.r.choice([14, 16, 18]))}"

    def ibans(self) -> str:
        x = self.iban()
        return " ".join(x[k : k + 4] for k in range(0, len(x), 4))

    def ssn(self) -> str:
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(4)}"

    def number(self) -> str:
        return str(self.r.choice([self.r.randrange(100), self.r.randrange(10_000), self.r.randrange(1_000_000)]))

    def small(self) -> str:
        return str(self.r.randrange(1, 99))

    def year(self) -> str:
        return str(self.r.randrange(1500, 2100))

    def date(self) -> str:
        return f"{self.r.randrange(1900, 2100)}-{self.r.randrange(1, 13):02}-{self.r.randrange(1, 29):02}"

    def version(self) -> str:
        return self.r.choice([f"{self.r.randrange(1, 9)}.{self.r.randrange(10)}", f"1.{self.r.randrange(9)}.{self.r.randrange(9)}"])

    def page(self) -> str:
        return f"{self.r.randrange(1, 99)}-{self.r.randrange(100, 999)}"


#: What a slot is a span of.
_SPAN = {"name": "name", "address": "address", "email": "email", "spelled": "email", "ip": "ip", "card": "card", "cards": "card", "phone": "phone", "code": "secret", "password": "secret", "iban": "iban", "ibans": "iban", "ssn": "national_id"}


def fill(pattern: str, value: Callable[[str], str], spans: dict[str, str] = _SPAN) -> tuple[str, list[tuple[int, str, int]]]:
    """The sentence of a pattern and its spans (start, kind, end)."""
    text, found = "", []
    for part in pattern.split("{"):
        slot, brace, rest = part.partition("}")
        if not brace:
            text += part
            continue
        start = len(text)
        text += value(slot)
        if slot in spans:
            found.append((start, spans[slot], len(text)))
        text += rest
    local = text.find("(") if pattern.startswith(("phone {local}", "call {local}")) else -1
    if local >= 0:  # a local number is one where a word before it says so
        found.append((local, "phone", local + 14))
    if "+1 {area} {rest}" in pattern:
        at = text.index("+1 (")
        found.append((at, "phone", at + 17))
    return text, sorted(found)


def table(seed: int = 7, rounds: int = 8) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Sentences with their spans, each pattern ``rounds`` times, among words of no interest."""
    values = _Values(seed)
    out = []
    for _ in range(rounds):
        for pattern in (*PATTERNS, *PLAIN):
            text, spans = fill(pattern, lambda slot: getattr(values, slot)())
            before = " ".join(values.w() for _ in range(values.r.randrange(3))) + " " if values.r.random() < 0.5 else ""
            mark = values.r.choice(["", "", "", ".", ",", "!!", "###"])
            out.append((f"{before}{text}{mark}", [(s + len(before), k, e + len(before)) for s, k, e in spans]))
    return out
