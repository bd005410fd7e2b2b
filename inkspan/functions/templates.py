"""Section templates: {{name}} placeholders, checked up front, rendered as one column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import SPACE, squeeze

SECTIONS = ("frontmatter", "title", "abstract", "description", "claims")
DEFAULT = "{{frontmatter}}\n\n{{title}}\n\n{{abstract}}\n\n{{description}}\n\n{{claims}}"


class TemplateError(ValueError):
    """An unknown or unterminated placeholder."""


def parse(template: str) -> list[tuple[str, str]]:
    """("text" | "section", value) in turn."""
    out, at = [], 0
    while (start := template.find("{{", at)) >= 0:
        end = template.find("}}", start + 2)
        if end < 0:
            raise TemplateError("unterminated template placeholder: '{{' with no closing '}}'")
        name = template[start + 2 : end].strip()
        if name not in SECTIONS:
            raise TemplateError(f"unknown template placeholder {{{{{name}}}}}; expected one of {', '.join(SECTIONS)}")
        out += [("text", template[at:start]), ("section", name)]
        at = end + 2
    return [x for x in [*out, ("text", template[at:])] if x[1]]


def render(sections: dict[str, Column], template: str = DEFAULT) -> Column:
    parts = [F.lit(v) if k == "text" else F.coalesce(sections[v], F.lit("")) for k, v in parse(template)]
    return squeeze(F.concat(*parts)) if parts else F.lit("")


def render_text(sections: dict[str, str], template: str = DEFAULT) -> str:
    whole = "".join(v if k == "text" else sections.get(v) or "" for k, v in parse(template))
    return re.sub(r"\n{3,}", "\n\n", whole).strip(SPACE)
