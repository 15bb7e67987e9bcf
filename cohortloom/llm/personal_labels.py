"""A small labelled table of personal data, made by rule: texts with their true spans, and decoys.

Each text is filler words around one to three items. An item is personal data in one of its
usual ways of writing, also those that the plain patterns miss, or a decoy that looks alike:
dates, prices, versions, order numbers, digit runs that fail a card's check digit.
"""

import random

# In a format, 9 stands for any digit, a for a lower-case letter, f for a hex digit.
PHONES = ("+1 (999) 999-9999", "+49 99 9999999", "+33 9 99 99 99 99", "+34 999 999 999", "(999) 999-9999", "999-999-9999",
          "999.999.9999", "999 999 9999", "1-999-999-9999", "1 (999) 999-9999", "(099) 9999999", "099 99999999", "0999 999999",
          "099/9999999", "0999-9999999", "09 99 99 99 99", "099 999 99 99", "0049 99 9999999", "0033 9 99 99 99 99")
CUED_PHONES = ("999-9999", "999 9999", "9999999999", "09999999999", "999 999 999", "999999999")
PHONE_CUES = ("call", "phone", "phone:", "tel", "tel.", "Tel:", "telephone", "mobile", "mobile:", "fax", "ring", "dial", "Telefon", "Telefon:",
              "Handy", "Rufnummer", "anrufen", "téléphone", "tél.", "portable", "appelez", "teléfono", "teléfono:", "móvil", "llame")
OTHER_CUES = ("order", "invoice", "ISBN", "version", "page", "ticket", "case", "number", "No.", "item", "Bestellung", "Rechnung", "Artikel",
              "Nummer", "commande", "facture", "numéro", "pedido", "factura", "número", "since", "on", "at", "about", "id")
ADDRESSES = ("aaaa.99@aaaa9.aaaaaaa.com", "aaaa@aaaaaa.org", "aa.aaaaa@aaa.de", "a99@aaa.example.net", "aaaa_aa+9@aaaaa.co.uk",
             "aaaa@äaaaaa.de", "aa9@üaaa.de", "aaaa.aaaa@éaaa.be", "aaa@ñaaaa.es", "aaaaa @ aaaa.com", "aa.aa @ aaaaa9.org")
NUMBER_ADDRESSES = ("{0}.{1}.{2}.{3}", "{0}[.]{1}[.]{2}[.]{3}", "{0}.{1}.{2}[.]{3}", "{0}(.){1}(.){2}(.){3}")
WIDE_ADDRESSES = ("2001:ff8:ffff:ffff::9", "fe80::ffff:99ff:fe9f:ffff", "2f02:ff9:ff::ff9", "2001:9ff9:9:ff9f:f9ff:9f:9fff:99f9", "2001:4860:4860::8888")
CARDS = ("9999999999999999", "9999 9999 9999 9999", "9999-9999-9999-9999", "9999.9999.9999.9999", "9999/9999/9999/9999", "9999 999999 99999")
DECOYS = ("9999-99-99", "99.99.9999", "99/99/9999", "9/9/9999", "99:99:99", "99:99", "9.9", "9.9.9", "9999", "99", "9", "999", "$9,999.99", "99,99 €",
          "99 %", "978-9-9999-9999-9", "9999-9999", "999-999", "#99999", "99999999", "999999", "9 999 999", "9,999,999", "9.999.999", "99 x 99",
          "99.9999, 9.9999", "ff:ff:ff:ff:ff:ff", '"ffffffffffffffffffffffffffffffffffffffff"', "a9a9aaa9", "aa-9999", "@aaaa9", "9@9", "aaa@", "99999 aaaa",
          "9999 9999", "99 99 99", "9 9 9 9 9 9", "99 999 9 9999 99", "999.999", "aaa/99", "v9.9", "9999/99")
# End of fixed values.

SOUNDS = ("an", "be", "chi", "do", "el", "fru", "gen", "ha", "ión", "ja", "ke", "lu", "ment", "no", "ör", "pa", "que", "ri", "sch", "té", "ü", "va")


def _fill(form: str, r: random.Random) -> str:
    kinds = {"9": "0123456789", "f": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz"}
    return "".join(r.choice(kinds[c]) if c in kinds else c for c in form)


def _card(form: str, r: random.Random, passing: bool) -> str:
    """The form with digits whose check digit holds, or fails."""
    out = list(_fill(form, r))
    at = [i for i, c in enumerate(out) if c.isdigit()]
    total = sum(sum(divmod(int(out[i]) * (2 if k % 2 else 1), 10)) for k, i in enumerate(reversed(at)) if k)
    out[at[-1]] = str((-total + (0 if passing else r.randrange(1, 10))) % 10)
    return "".join(out)


def _item(r: random.Random) -> tuple[str, str, str]:
    """(kind or '', words before, item)."""
    kind = r.choice(("email", "ip", "card", "phone", "phone", "phone", "", "", "", ""))
    cue = r.choice(("", "", f"{r.choice(PHONE_CUES if kind == 'phone' else OTHER_CUES)} "))
    if kind == "email":
        return kind, cue, _fill(r.choice(ADDRESSES), r)
    if kind == "ip":
        if r.random() < 0.3:
            return kind, cue, _fill(r.choice(WIDE_ADDRESSES), r)
        return kind, cue, r.choice(NUMBER_ADDRESSES).format(*(r.randrange(256) for _ in range(4)))
    if kind == "card":
        return kind, cue, _card(r.choice(CARDS), r, True)
    if kind == "phone":
        if r.random() < 0.25:
            return kind, f"{r.choice(PHONE_CUES)} ", _fill(r.choice(CUED_PHONES), r)
        return kind, cue, _fill(r.choice(PHONES), r)
    if r.random() < 0.1:
        return "", cue, _card(r.choice(CARDS), r, False)
    if r.random() < 0.1:
        return "", f"{r.choice(OTHER_CUES)} ", _fill(r.choice(("9999999999", "999999999", "99999999999")), r)
    if r.random() < 0.1:
        return "", cue, ".".join(str(r.randrange(256, 1000)) for _ in range(4))
    return "", cue, _fill(r.choice(DECOYS), r)


def labelled_texts(rows: int = 800, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans as (kind, start, end) in code points), the same for the same arguments."""
    r = random.Random(seed)
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            for _ in range(r.choice((0, 1, 3, 6))):
                word = "".join(r.choice(SOUNDS) for _ in range(r.randrange(1, 4)))
                text += (word.capitalize() if r.random() < 0.2 else word) + r.choice(("", "", "", ".", ",")) + " "
            kind, before, item = _item(r)
            text += before + r.choice(("", "", "", "(", '"') if not item.startswith("(") else ("",))
            if kind:
                spans.append((kind, len(text), len(text) + len(item)))
            text += item + r.choice(("", "", "", ".", ",", ")", "%%%", "###")) + r.choice((" ", " ", "\n"))
        out.append((text + "".join(f"{r.choice(SOUNDS)} " for _ in range(r.randrange(4))), spans))
    return out
