"""Strain configurations: small JSON documents that are read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Strain:
    name: str
    title: str = ""
    taxon: int = 562
    kegg_code: str = "eco"
    deviations: float = 0.0
    interaction_species: list[int] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)
    samples: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    swath: dict[str, str] = field(default_factory=dict)
    metabolite_files: list[str] = field(default_factory=list)
    sample_sheet: str = ""


#: Where each kind of file is looked for if it isn't named: folder, pattern.
_PLACES = {"gff": ("genome", "*.gff*"), "expression": ("transcriptomic", "*cpmlog2*"), "counts": ("transcriptomic", "*count*"), "proteins": ("proteomics", "*.[ctpx][sal]*"), "orthologs": ("annotation", "*eggnog*"), "entries": ("annotation", "*uniprot*.json*"), "interactions": ("annotation", "*string*")}
#: What else a kind of file is called among a configuration's paths.
_NAMED = {"gff": ("genome_gff",), "expression": ("rna_log2_cpm", "rna_cpmlog2"), "counts": ("rna_counts",), "proteins": ("prot_file",)}
#: Fixed value: the species that networks are asked for where a configuration names none.
SPECIES = 511145
SHEET = "Area - proteins"


def _of(name: str, root: Path, doc: dict) -> Strain:
    at = lambda p: str(Path(p) if Path(p).is_absolute() else (root / p).resolve())
    files = {}
    for kind, (folder, pattern) in _PLACES.items():
        named = next((doc["paths"][k] for k in (*_NAMED.get(kind, ()), kind) if doc.get("paths", {}).get(k)), None)
        found = sorted((root / folder).rglob(pattern)) if (root / folder).is_dir() else []
        if named:
            files[kind] = at(named)
        elif found:
            files[kind] = str(found[0])
    tx, px, mx = doc.get("transcriptomics", {}), doc.get("proteomics", {}), doc.get("metabolomics", {})
    sw = px.get("swath", {})
    if sw.get("file"):
        files["proteins"] = at(sw["file"])
    both = lambda d, kind: {"RPMI": [str(x) for x in d.get(f"rpmi_{kind}", [])], "Sera": [str(x) for x in d.get(f"sera_{kind}", [])]}
    species = [doc.get(k, SPECIES) for k in ("string_species_primary", "string_species_fallback")]
    return Strain(
        name, doc.get("name", name), doc.get("ncbi_tax_id", 562), doc.get("kegg_code", "eco"), float(doc.get("regulation_std_multiplier", 0.0)), list(dict.fromkeys(species)), files,
        {"rna": both(tx, "samples"), "protein": both(px, "ids"), "metabolite": both(mx, "samples")},
        {"protein": sw.get("protein_col") or px.get("protein_col") or "Protein", "RPMI": sw.get("rpmi_template") or "{sid}", "Sera": sw.get("sera_template") or "{sid}", "sheet": sw.get("sheet") or px.get("sheet") or SHEET},
        [at(p) for p in mx.get("maf_files", [])] if mx.get("enabled", False) else [], at(mx["sample_file"]) if mx.get("sample_file") else "",
    )


def _central(central: str | None) -> dict:
    """The strains of a central file: at its top, or under strains."""
    if not central or not Path(central).is_file():
        return {}
    doc = json.loads(Path(central).read_text())
    return doc["strains"] if isinstance(doc.get("strains"), dict) and "paths" not in doc["strains"] else doc


def names(root: str, central: str | None = None) -> list[str]:
    """All strains, by name: folders with a configuration, but for the template, and those of the central file."""
    found = {p.parent.name for p in Path(root).glob("*/config.json") if p.parent.name != "TEMPLATE"}
    return sorted(found | set(_central(central)))


def load(name: str, root: str, central: str | None = None) -> Strain:
    """The strain's own folder goes before the central file; ValueError if neither has it."""
    own = Path(root) / name / "config.json"
    if own.is_file():
        return _of(name, own.parent, json.loads(own.read_text()))
    strains = _central(central)
    if name in strains:
        return _of(name, Path(central).parent, strains[name])
    raise ValueError(f"no configuration of {name}; known are {', '.join(names(root, central)) or 'none'}")
