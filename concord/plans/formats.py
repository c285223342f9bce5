"""The named formats of JSON Schema as portable patterns, put together from the rules of their RFCs.

A format is a list of patterns that a text must match, all of them, and the most characters that it may have. ``regex``
has no pattern: it asks whether a text is one.
"""

from __future__ import annotations

import re

#: The names that JSON Schema defines.
NAMES = (
    "date-time", "date", "time", "duration", "email", "idn-email", "hostname", "idn-hostname", "ipv4", "ipv6", "uri", "uri-reference", "iri", "iri-reference",
    "uuid", "uri-template", "json-pointer", "relative-json-pointer", "regex",
)

_LEAP = "([0-9]{2}(0[48]|[2468][048]|[13579][26])|([02468][048]|[13579][26])00)-02-29"
_DATE = f"([0-9]{{4}}-((0[13578]|1[02])-(0[1-9]|[12][0-9]|3[01])|(0[469]|11)-(0[1-9]|[12][0-9]|30)|02-(0[1-9]|1[0-9]|2[0-8]))|{_LEAP})"
_OFFSET = "([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"
_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"


def _leap_seconds() -> str:
    """23:59:60 in UTC: at every offset the local time that it is."""
    out = [r"23:59:60(\.[0-9]+)?[Zz]"]
    for hours in range(24):
        for sign in "+-":
            # UTC is local minus offset; only the hour and, with minutes, the minute of the local time follow.
            whole = (23 + hours if sign == "+" else 23 - hours) % 24
            out.append(rf"{whole:02d}:59:60(\.[0-9]+)?\{sign}{hours:02d}:00")
            for minutes in (15, 30, 45):
                local = (23 * 60 + 59 + (hours * 60 + minutes) * (1 if sign == "+" else -1)) % 1440
                out.append(rf"{local // 60:02d}:{local % 60:02d}:60(\.[0-9]+)?\{sign}{hours:02d}:{minutes:02d}")
    return "|".join(out)


_TIME = f"({_CLOCK}{_OFFSET}|{_leap_seconds()})"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"({_OCTET}\.){{3}}{_OCTET}"


def _ipv6() -> str:
    """Eight groups, the last two perhaps an IPv4 address, and one run of zero groups perhaps left out."""
    group = "[0-9A-Fa-f]{1,4}"
    last = f"({group}:{group}|{_IPV4})"
    out = [f"({group}:){{6}}{last}", f"(({group}:){{0,6}}{group})?::"]
    for after in range(8):
        # So many groups after the gap; the gap stands for one group at least.
        tail = group if after == 1 else f"({group}:){{{after - 2}}}{last}" if after >= 2 else ""
        room = 7 - after
        if tail:
            out.append((f"(({group}:){{0,{room - 1}}}{group})?" if room else "") + f"::{tail}")
    return "(" + "|".join(out) + ")"


_IPV6 = _ipv6()
def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in pairs)



#: Characters beyond ASCII that stand in names of an IRI, and in queries.
_UCS = _ranges((0xA0, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFEF), *((p << 16, (p << 16) + 0xFFFD) for p in range(1, 14)), (0xE1000, 0xEFFFD))
_PRIVATE = _ranges((0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD))


def _uri(more: str, private: str) -> tuple[str, str]:
    """A URI and a reference; ``more`` are characters of names, ``private`` of queries, beyond ASCII."""
    name, pct = f"A-Za-z0-9._~{more}", "%[0-9A-Fa-f]{2}"
    sub = "!$&'()*+,;="
    char = f"([{name}{sub}:@-]|{pct})"
    user, reg = f"([{name}{sub}:-]|{pct})*", f"([{name}{sub}-]|{pct})*"
    literal = rf"\[({_IPV6}|[vV][0-9A-Fa-f]+\.[A-Za-z0-9._~{sub}:-]+)\]"
    authority = f"//({user}@)?({literal}|{reg})(:[0-9]*)?(/{char}*)*"
    absolute, rootless = f"/({char}+(/{char}*)*)?", f"{char}+(/{char}*)*"
    noscheme = f"([{name}{sub}@-]|{pct})+(/{char}*)*"
    tail = rf"(\?({char}|[/?{private}])*)?(#({char}|[/?])*)?"
    whole = f"[A-Za-z][A-Za-z0-9+.-]*:({authority}|{absolute}|{rootless})?{tail}"
    return whole, f"({whole}|({authority}|{absolute}|{noscheme})?{tail})"


_URI, _URI_REF = _uri("", "")
_IRI, _IRI_REF = _uri(_UCS, _PRIVATE)
_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_WIDE = f"A-Za-z0-9{_UCS}"
_IDN_LABEL = f"[{_WIDE}]([{_WIDE}-]{{0,61}}[{_WIDE}])?"


def _email(more: str, host: str) -> str:
    atom = f"[A-Za-z0-9!#$%&'*+/=?^_`{{|}}~{more}-]+"
    quoted = rf'"([ !#-\[\]-~{more}]|\\[ -~{more}])*"'
    literal = rf"\[({_IPV4}|IPv6:{_IPV6})\]"
    return rf"({atom}(\.{atom})*|{quoted})@({host}|{literal})"


_DOTS = "." + "".join(map(chr, (0x3002, 0xFF0E, 0xFF61)))
_HOST, _IDN_HOST = rf"{_LABEL}(\.{_LABEL})*", f"{_IDN_LABEL}([{_DOTS}]{_IDN_LABEL})*"
_VARIABLE = r"([A-Za-z0-9_]|%[0-9A-Fa-f]{2})+(\.([A-Za-z0-9_]|%[0-9A-Fa-f]{2})+)*(:[1-9][0-9]{0,3}|\*)?"
_LITERAL = rf"([!#$&(-;=?-\[\]_a-z~{_UCS}{_PRIVATE}]|%[0-9A-Fa-f]{{2}})"
_POINTER = "(/([^~/]|~[01])*)*"
_DAYS, _CLOCK_PART = "([0-9]+D|[0-9]+M([0-9]+D)?|[0-9]+Y([0-9]+M([0-9]+D)?)?)", "T([0-9]+H([0-9]+M([0-9]+S)?)?|[0-9]+M([0-9]+S)?|[0-9]+S)"
_DATE_TIME = f"{_DATE}[Tt]{_TIME}"

#: Format to its patterns.
PATTERNS: dict[str, tuple[str, ...]] = {
    name: tuple(rf"^({x})\z" for x in parts)
    for name, parts in {
        "date": (_DATE,),
        "time": (_TIME,),
        "date-time": (_DATE_TIME,),
        "duration": (f"P({_DAYS}({_CLOCK_PART})?|{_CLOCK_PART}|[0-9]+W)",),
        "email": (_email("", _HOST),),
        "idn-email": (_email(_UCS, _IDN_HOST),),
        "hostname": (_HOST,),
        "idn-hostname": (_IDN_HOST,),
        "ipv4": (_IPV4,),
        "ipv6": (_IPV6,),
        "uri": (_URI,),
        "uri-reference": (_URI_REF,),
        "iri": (_IRI,),
        "iri-reference": (_IRI_REF,),
        "uuid": ("[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",),
        "uri-template": (rf"({_LITERAL}|\{{[+#./;?&=,!@|]?{_VARIABLE}(,{_VARIABLE})*\}})*",),
        "json-pointer": (_POINTER,),
        "relative-json-pointer": (f"(0|[1-9][0-9]*)(#|{_POINTER})",),
        "regex": (),
    }.items()
}
#: The most characters, where there is such a bound.
LONGEST = {"hostname": 253, "idn-hostname": 253}
#: Formats that the empty text has.
EMPTY = frozenset(name for name, parts in PATTERNS.items() if all(re.match(p.replace(r"\z", r"\Z"), "") for p in parts))
