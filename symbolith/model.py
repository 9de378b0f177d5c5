"""The data model: kinds of definitions, their categories, and the schemas of the engine's tables."""

from __future__ import annotations

#: The kinds in their fixed order, and the categories' members (fixed values).
KINDS = (
    "function class struct enum alias trait interface const record delegate event object protocol actor extension "
    "extension_type mixin module macro union method constructor getter setter operator field property var namespace "
    "package variant destructor subscript annotation concept module_declaration associated_type function_declaration "
    "method_declaration constructor_declaration destructor_declaration operator_declaration getter_declaration "
    "setter_declaration subscript_declaration property_declaration var_declaration const_declaration struct_declaration "
    "class_declaration union_declaration enum_declaration linkage impl"
).split()
CALLABLE = "function method constructor getter setter operator destructor subscript".split()
CATEGORIES = {
    "shape": "class struct enum union record object actor extension_type struct_declaration class_declaration union_declaration enum_declaration".split(),
    "callable": CALLABLE + [f"{k}_declaration" for k in CALLABLE],
    "value": "const event field property var variant property_declaration var_declaration const_declaration".split(),
    "contract": "interface protocol trait mixin delegate concept annotation".split(),
    "scope": "namespace package module module_declaration".split(),
}
CATEGORY_OF = {k: c for c, kinds in CATEGORIES.items() for k in kinds}
#: Kinds that have a form without a body.
DECLARED = {k: f"{k}_declaration" for k in KINDS if f"{k}_declaration" in KINDS}

DEFS = "path string, ordinal int, language string, kind string, line_start int, line_end int, scope string, signature string"
ERRORS = "path string, phase string, message string"


def kinds_of(tag: str) -> list[str]:
    """Kinds that a tag stands for: a category, ``<kind>_definition`` (that kind alone), a kind with its declaration
    form, or a plain kind; empty if it is none of these."""
    if tag in CATEGORIES:
        return list(CATEGORIES[tag])
    if tag.endswith("_definition") and (kind := tag.removesuffix("_definition")) in KINDS:
        return [kind]
    if tag in DECLARED:
        return [tag, DECLARED[tag]]
    return [tag] if tag in KINDS else []


def resolve(tags: list[str]) -> list[str]:
    """Kinds of all tags in their fixed order; ValueError names the tags that are unknown.  No tags: all kinds."""
    if unknown := [t for t in tags if not kinds_of(t)]:
        raise ValueError(f"unknown kind: {', '.join(unknown)}")
    found = {k for t in tags for k in kinds_of(t)}
    return [k for k in KINDS if k in found or not tags]
