"""Ordered rule tables that turn annotation text into a functional category, and the columns that apply them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order in which they are tried, each with its terms in the order in which they are tried.

KEYWORDS = {
    "structural": [
        "capsid", "coat", "envelope", "spike", "matrix", "tail", "fiber", "portal", "shell", "head", "virion", "glycoprotein", "membrane protein",
        "membrane-associated", "nucleocapsid", "nucleoprotein", "tegument", "baseplate", "assembly", "maturation", "fusion protein",
        "fusion glycoprotein", "fusion", "attachment", "structural polyprotein", "surface protein", "surface antigen", "surface glycoprotein",
        "core protein", "core antigen", "outer capsid", "inner capsid", "hemagglutinin", "neuraminidase", "gag polyprotein", "gag-pro-pol",
        "pre-membrane",
    ],
    "replication": [
        "polymerase", "replicase", "helicase", "primase", "rdrp", "reverse transcriptase", "rep protein", "nsp12", "nsp13", "phosphoprotein",
        "polymerase cofactor",
    ],
    "protease": [
        "protease", "proteinase", "peptidase", "maturase", "3cl", "mpro", "nsp5",
    ],
    "nuclease": [
        "nuclease", "endonuclease", "exonuclease", "integrase", "recombinase", "ligase", "rnase", "dnase",
    ],
    "packaging": [
        "terminase", "packaging", "scaffold", "portal protein",
    ],
    "host_interaction": [
        "interferon antagonist", "immune evasion", "immune antagonist", "interferon inhibitor", "innate immune", "accessory protein", "viroporin",
        "immune modulator", "ion channel protein", "v protein", "anti-restriction", "anti-crispr", "anti-defense", "host shutoff", "host defense",
        "host division inhibitor", "host cell division inhibitor", "host takeover", "ocr", "dgtpase inhibitor",
    ],
    "regulatory": [
        "transcription", "repressor", "activator", "regulator", "anti-repressor", "antirepressor", "translation enhancer", "translation effector",
        "effector protein", "leader protein", "nonstructural protein", "non-structural protein", "transactivator", "trans-activating",
        "immediate-early", "methyltransferase",
    ],
    "movement": [
        "movement", "cell-to-cell", "transport protein", "movement protein", "plasmodesmata", "tubule-forming", " mp",
    ],
    "lysis": [
        "lysin", "holin", "endolysin", "spanin", "lysis",
    ],
    "entry": [
        "viral entry", "cell entry", "receptor binding", "receptor-binding", "entry protein",
    ],
}

PFAM = {
    "structural": [
        "capsid", "coat protein", "matrix protein", "virion", "envelope", "glycoprotein", "spike", "nucleocapsid", "nucleoprotein", "vp1", "vp2",
        "vp3", "vp4", "vp5", "vp6", "vp7", "major capsid", "minor capsid", "picornavirus capsid", "circovirus capsid", "polyomavirus coat",
        "parvovirus coat", "vesiculovirus matrix", "rhabdovirus spike", "herpes virus major capsid", "herpesvirus vp23", "herpesvirus glycoprotein",
        "adenovirus hexon", "adenovirus penton", "fiber protein", "tail protein", "baseplate", "portal protein", "head protein", "tegument",
        "membrane protein", "structural envelope", "assembly protein", "maturation protein", "fusion protein", "fusion glycoprotein",
        "attachment protein", "coronavirus m matrix", "surface protein", "surface antigen", "surface glycoprotein", "core protein", "hemagglutinin",
        "neuraminidase", "gag polyprotein", "pre-membrane protein", "outer capsid protein", "inner capsid protein",
    ],
    "replication": [
        "polymerase", "rdrp", "rna-dependent rna polymerase", "dna polymerase", "reverse transcriptase", "helicase", "rna helicase", "dna helicase",
        "primase", "dna primase", "replicase", "rep protein", "parvovirus non-structural", "ns1", "nsp12", "nsp13", "viral helicase",
        "superfamily 1 rna helicase", "superfamily 2 helicase", "phosphoprotein", "polymerase cofactor", "thymidine kinase", "thymidylate",
        "ribonucleotide reductase", "dutpase", "uracil dna glycosylase",
    ],
    "protease": [
        "protease", "peptidase", "proteinase", "maturase", "assemblin", "3cl protease", "mpro", "nsp5", "serine endopeptidase", "cysteine protease",
        "cysteine proteinase", "cysteine-type peptidase", "metalloprotease", "aspartic protease", "otu", "ovarian tumor",
    ],
    "nuclease": [
        "nuclease", "endonuclease", "exonuclease", "rnase", "dnase", "integrase", "recombinase", "ligase", "dna ligase", "rna ligase", "dutpase",
        "uracil dna glycosylase", "dna/rna non-specific endonuclease", "pd-(d/e)xk", "giy-yig", "hnh", "restriction enzyme",
    ],
    "packaging": [
        "terminase", "packaging", "scaffold", "dna packaging", "genome packaging", "portal", "ul6",
    ],
    "regulatory": [
        "transcription", "transcriptional regulator", "repressor", "activator", "regulator", "anti-repressor", "trans-activator", "transactivator",
        "immediate-early", "protein kinase", "kinase domain", "translation enhancer", "translation effector", "translation regulation",
        "methyltransferase", "cap methyltransferase",
    ],
    "host_interaction": [
        "interferon antagonist", "interferon inhibitor", "immune evasion", "immune antagonist", "innate immune", "stat inhibitor",
        "nf-kappa-b inhibitor", "accessory protein", "viroporin", "immune modulator", "anti-restriction", "anti-crispr", "anti-defense",
        "host defense inhibitor", "host nuclease inhibitor",
    ],
    "movement": [
        "movement protein", "cell-to-cell", "transport protein", "tubule-forming",
    ],
    "lysis": [
        "lysin", "holin", "endolysin", "spanin", "lysis", "lysozyme", "muramidase", "amidase", "peptidoglycan",
    ],
}

GO_PROCESS = {
    "structural": [
        "viral capsid assembly", "virion assembly", "viral particle assembly", "capsid assembly",
    ],
    "replication": [
        "dna replication", "viral genome replication", "viral dna genome replication", "viral rna genome replication", "rna-templated transcription",
        "dna-templated transcription", "telomere maintenance", "tmp biosynthetic process", "thymidine biosynthetic process",
        "nucleotide biosynthetic process", "deoxyribonucleotide biosynthetic process",
    ],
    "protease": [
        "proteolysis", "viral protein processing", "protein processing",
    ],
    "nuclease": [
        "dna repair", "dna recombination", "dna integration",
    ],
    "packaging": [
        "viral dna genome packaging", "dna packaging", "genome packaging", "chromosome organization",
    ],
    "regulatory": [
        "regulation of dna-templated transcription", "positive regulation of dna-templated transcription", "negative regulation of transcription",
        "viral transcription", "protein phosphorylation", "regulation of dna replication",
    ],
    "host_interaction": [
        "virus-mediated perturbation of host defense response", "modulation by virus of host process", "immune response", "immune evasion",
        "modulation by virus of host immune response", "suppression by virus of host immune response", "evasion of host immune response",
    ],
    "entry": [
        "fusion of virus membrane with host plasma membrane", "virion attachment to host cell", "viral entry", "membrane fusion",
    ],
    "lysis": [
        "lysis", "cell lysis", "host cell lysis",
    ],
}

GO_FUNCTION = {
    "structural": [
        "structural molecule activity", "structural constituent of virion",
    ],
    "replication": [
        "dna-directed 5'-3' rna polymerase activity", "rna-dependent rna polymerase activity", "dna-directed dna polymerase activity",
        "dna polymerase activity", "dna-directed 5'-3' dna polymerase activity", "dna helicase activity", "rna helicase activity",
        "dna primase activity", "dna binding", "nucleotide binding", "atp binding", "atp hydrolysis activity", "single-stranded dna binding",
        "kinase activity",
    ],
    "protease": [
        "serine-type endopeptidase activity", "cysteine-type peptidase activity", "metalloendopeptidase activity",
        "aspartic-type endopeptidase activity", "peptidase activity",
    ],
    "nuclease": [
        "nuclease activity", "endonuclease activity", "exonuclease activity", "dna ligase activity", "rna ligase activity",
        "endodeoxyribonuclease activity",
    ],
    "regulatory": [
        "protein kinase activity", "methyltransferase activity", "transcription factor activity",
    ],
}

SUPERFAMILY = {
    "structural": [
        "viral glycoprotein", "positive stranded ssrna viruses", "vsv matrix protein", "ev matrix protein", "group i dsdna viruses",
        "viral glycoprotein ectodomain", "ndv fusion glycoprotein", "wssv envelope", "p40 nucleoprotein", "nucleoprotein", "immunoglobulin",
        "flaviviral glycoprotein", "herpesvirus glycoprotein b",
    ],
    "replication": [
        "dna/rna polymerases", "p-loop containing nucleoside triphosphate hydrolases", "ribonuclease h-like",
        "beta and beta-prime subunits of dna dependent rna-polymerase", "dna ligase/mrna capping enzyme", "dna clamp",
    ],
    "protease": [
        "cysteine proteinases", "metalloproteases", "zincins",
    ],
    "nuclease": [
        "dnase i-like", "dutpase-like", "pin domain-like",
    ],
    "regulatory": [
        "s-adenosyl-l-methionine-dependent methyltransferases", "protein kinase-like", "ankyrin repeat", "ring/u-box", "tata-box binding protein-like",
        "dna-binding domain of mlu1-box", "fkbp12-rapamycin-binding domain",
    ],
    "host_interaction": [
        "bcl-2 inhibitors of programmed cell death", "viroporin",
    ],
}
#: Categories of the simple inference, and pairs of categories that are related.
SIMPLE = {
    "structural": ["capsid", "coat", "envelope", "spike", "matrix", "tail", "fiber"],
    "replication": ["polymerase", "replicase", "helicase", "primase", "rdrp"],
    "protease": ["protease", "peptidase", "maturase", "cleavage"],
    "nuclease": ["nuclease", "endonuclease", "exonuclease", "integrase"],
    "packaging": ["terminase", "packaging", "scaffold", "portal"],
    "regulatory": ["transcription", "repressor", "activator", "regulator"],
    "lysis": ["lysin", "holin", "endolysin", "spanin"],
}
RELATED = [("structural", "packaging"), ("replication", "nuclease"), ("protease", "regulatory")]
#: Viral families by keyword of a description.
FAMILIES = {
    "rdrp": ["Coronaviridae", "Picornaviridae", "Flaviviridae", "Togaviridae"],
    "polymerase": ["Coronaviridae", "Rhabdoviridae", "Paramyxoviridae", "Orthomyxoviridae"],
    "capsid": ["Picornaviridae", "Caliciviridae", "Astroviridae", "Nodaviridae"],
    "nucleocapsid": ["Coronaviridae", "Rhabdoviridae", "Paramyxoviridae", "Bunyavirales"],
    "spike": ["Coronaviridae", "Paramyxoviridae"],
    "protease": ["Coronaviridae", "Picornaviridae", "Flaviviridae"],
    "helicase": ["Coronaviridae", "Flaviviridae", "Picornaviridae"],
    "terminase": ["Caudovirales", "Herpesviridae"],
    "portal": ["Caudovirales", "Herpesviridae"],
    "tail": ["Caudovirales", "Myoviridae", "Siphoviridae", "Podoviridae"],
    "lysin": ["Caudovirales"],
    "integrase": ["Retroviridae", "Caudovirales"],
}
#: Characters behind and before a keyword in which an inhibitor or a host is looked for.
BEHIND, BEFORE = 30, 15


def flat(table: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(category, term) in the order in which they are tried."""
    return [(category, term) for category, terms in table.items() for term in terms]


def _literal(pairs: list[tuple[str, str]]) -> Column:
    """The pairs as one constant, parsed from text: a call to the JVM for each term would take seconds."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"named_struct('category', {quoted(c)}, 'term', {quoted(t)})" for c, t in pairs) + ")")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def first_rule(text: Column, table: dict[str, list[str]]) -> Column:
    """The first (category, term) whose term stands in the text, which is in lower case; null if none does."""
    return F.get(F.filter(_literal(flat(table)), lambda r: F.contains(text, r["term"])), 0)


def by_terms(text: Column, table: dict[str, list[str]]) -> Column:
    """Category of the first matching term; null for null or empty text and without a match."""
    return F.when(F.length(text) > 0, bound(F.lower(text), lambda t: first_rule(t, table)["category"]))


def by_keywords(description: Column, gene: Column | None = None) -> Column:
    """Category by keywords of description and gene; ``unknown`` without a match.

    The first keyword of the table decides. Where its first occurrence is followed by an inhibitor or preceded by a host,
    the protein acts on the host, whatever the keyword's own category.
    """
    text = F.lower(F.concat(F.coalesce(description, F.lit("")), F.lit(" "), F.coalesce(gene, F.lit("")) if gene is not None else F.lit("")))

    def decided(text: Column, rule: Column) -> Column:
        at, size = F.instr(text, rule["term"]), F.length(rule["term"])
        behind = F.substring(text, at + size, F.lit(BEHIND))
        before = F.substring(text, F.greatest(at - BEFORE, F.lit(1)), F.least(at - 1, F.lit(BEFORE)))
        host = F.contains(behind, F.lit("inhibitor")) | F.contains(behind, F.lit("inhibition")) | F.contains(before, F.lit("host"))
        return F.when(rule.isNull(), "unknown").when((rule["category"] != "host_interaction") & host, "host_interaction").otherwise(rule["category"])

    return bound(text, lambda t: bound(first_rule(t, KEYWORDS), lambda r: decided(t, r)))


def by_evidence(description: Column, gene: Column | None, pfam: Column | None, superfamily: Column | None, process: Column | None, function: Column | None) -> tuple[Column, Column]:
    """Category by the strongest evidence that gives one (Pfam, SUPERFAMILY, GO process, GO function, keywords), and which it was; None is evidence that there isn't."""
    ladder = [("pfam", pfam, PFAM), ("superfamily", superfamily, SUPERFAMILY), ("go_bp", process, GO_PROCESS), ("go_mf", function, GO_FUNCTION)]
    found = [(name, text, by_terms(text, table)) for name, text, table in ladder if text is not None]
    category = F.coalesce(*[c for _, _, c in found], by_keywords(description, gene))
    source = F.coalesce(*[F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), text)) for name, text, c in found], F.lit("keywords"))
    return category, source


def families(description: Column) -> Column:
    """Viral families that a description hints at, sorted."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.sort_array(F.array_distinct(F.flatten(F.array(*[F.when(F.contains(text, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in FAMILIES.items()]))))


def simple_category(description: Column) -> Column:
    return F.coalesce(by_terms(description, SIMPLE), F.lit("unknown"))
