"""Coefficients and vocabularies. Functions take them as arguments where a caller may want others."""

# Weights of the measuring system, the perturbation, the readout and the assay.
SYSTEM_WEIGHTS = {
    "human_population": 1.00,
    "primary_human_hspc": 1.00,
    "human_erythroid_progenitor_line": 0.75,
    "human_cancer_line": 0.35,
    "human_immortalized_line": 0.30,
    "mouse_model": 0.30,
    "mouse_line": 0.20,
    "non_human_other": 0.10,
    "cell_free_or_unspecified": 0.10,
}
PERTURBATION_WEIGHTS = {
    "base_edit": 1.00,
    "knock_in": 1.00,
    "genetic_variant": 1.00,
    "crispri": 0.85,
    "crispra": 0.70,
    "knockout": 0.70,
    "rnai": 0.40,
    "overexpression": 0.30,
    "unspecified": 0.35,
}
DIRECTNESS_WEIGHTS = {"direct_protein": 1.00, "transcript": 0.65, "proxy": 0.35}
ASSAY_MODIFIERS = {
    "gwas_association": 1.00,
    "depmap_gene_effect": 1.00,
    "orcs_screen_score": 1.00,
    "opentargets_genetic_association": 1.00,
    "opentargets_genetic_literature": 0.80,
    "opentargets_clinical": 1.00,
    "opentargets_animal_model": 0.60,
    "opentargets_literature": 0.25,
    "literature_comention": 0.20,
}
UNKNOWN_ASSAY = 0.5
REPLICATION = {0: 1.00, 1: 1.00, 2: 1.35, 3: 1.55}
REPLICATION_CAP = 1.70
GENETIC_BONUS, AUTHOR_REPORTED_PENALTY = 1.30, 0.55
LEAST_WEIGHT, MOST_WEIGHT = 0.01, 2.00

# How evidence moves a belief, and when a claim may be reported.
PRIOR_CONFIDENCE, EVIDENCE_STRENGTH = 0.05, 0.85
LITERATURE_SCALE, OTHER_LITERATURE = 1.0, 0.25
ESSENTIALITY_CEILING, PAN_ESSENTIAL = 1.20, 0.70
REFUSAL_THRESHOLD, LEAST_SUPPORT, LEAST_PUBLICATIONS, LEAST_COMPOSITION = 0.25, 0.30, 5, 0.25
COMPOSITION_DISCOUNT = 0.35
GENOME_WIDE, ESSENTIAL_EFFECT = 5e-8, -1.0
LITERATURE_CAP = 400

# The weight of each therapeutic route in the second ranking.
ROUTE_WEIGHTS = {"SMALL_MOLECULE": 10.0, "IN_VIVO_EDIT": 4.0, "EX_VIVO_SINGLE_EDIT": 1.0, "EX_VIVO_MULTI_EDIT": 0.4, "NOT_THERAPEUTIC": 0.0}

# Protein families by route, as patterns.
SMALL_MOLECULE_FAMILIES = (r"kinases?\b", r"\bphosphatases?\b", "methyltransferases?", "demethylases?", "deacetylases?", "acetyltransferases?", r"\bhelicases?\b", "nuclear hormone receptors", "nuclear receptors", r"\bproteases?\b", r"\bATPases?\b", "bromodomain", "SNF2 related", "deubiquitinases?", "ubiquitin ligases?", r"\bsirtuins?\b")
DNA_BINDING_FAMILIES = ("zinc fingers", "transcription factors", "Myb/SANT", "homeoboxes", "basic helix-loop-helix", r"\bGATA\b", "high mobility group")
COMPLEX_FAMILIES = ("NuRD complex", "CoREST complex", "BAF complex", "SWI/SNF", "Polycomb")

# Terms of the phenotype and of its context.
PHENOTYPE_TERMS = ("fetal hemoglobin", "fetal haemoglobin", "hbf", "f-cell", "f cell", "gamma-globin", "gamma globin", "hbg1", "hbg2", "globin switching", "hemoglobin f")
CONTEXT_TERMS = ("erythroid", "erythropoiesis", "erythrocyte", "hudep", "hspc", "cd34", "hematopoietic stem", "haematopoietic stem", "haemoglobin", "hemoglobin", "globin")

# Readouts of a trait, most direct first, and the labels of fitness and differentiation screens.
READOUTS = ((("f-cell", "f cell"), "f_cell"), (("protein", "hplc", "flow", "stain", "antibody"), "hbf_protein"), (("mrna", "transcript", "rna-seq", "expression"), "hbg_mrna"), (("reporter", "gfp", "sorted", "sort"), "hbg_reporter"))
FITNESS_LABELS = ("cell proliferation", "viability", "cell viability", "cell death", "cell growth", "growth", "cell fitness")
DIFFERENTIATION_LABELS = ("erythroid differentiation", "cell differentiation", "differentiation")

# Perturbation classes by library type or method, cell systems by accession, terms of primary and mouse cells.
PERTURBATION_CLASSES = {"crispri": "crispri", "crispra": "crispra", "crisprn": "knockout", "crispr-cas9": "knockout", "knockout": "knockout", "knockdown": "crispri", "activation": "crispra", "inhibition": "crispri", "base editing": "base_edit", "knock-in": "knock_in"}
KNOWN_SYSTEMS = {"CVCL_VI06": "human_erythroid_progenitor_line", "CVCL_VI05": "human_erythroid_progenitor_line", "CVCL_0004": "human_cancer_line", "CVCL_0001": "human_cancer_line", "CVCL_0379": "human_cancer_line", "CVCL_0559": "human_cancer_line", "CVCL_0045": "human_immortalized_line", "CVCL_0030": "human_cancer_line"}
PRIMARY_TERMS = ("cd34", "hspc", "primary human erythroid", "primary erythroid", "peripheral blood stem", "mobilized peripheral blood", "bone marrow cd34", "cord blood", "hematopoietic stem and progenitor", "haematopoietic stem and progenitor")
MOUSE_TERMS = ("mouse", "murine", "mus musculus", "m. musculus")

# What must not be passed on: field names, the longest text, and the fields that may be longer.
FORBIDDEN_FIELDS = ("abstract", "abstracttext", "abstract_text", "fulltext", "full_text", "body", "bodytext", "body_text", "text", "content", "articletext", "article_text", "paragraph", "paragraphs", "sections", "textmininsentences", "textminingsentences", "sentences", "snippet", "excerpt", "pdf", "supplementary_text")
LONG_FIELDS = ("significance_rule", "notes", "rationale", "modality_rationale", "note", "detail", "statement", "caveat")
LONGEST_FIELD = 600

# Greek letters as titles spell them out, and what negates the name behind it.
GREEK = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "Α": "alpha", "Β": "beta", "Γ": "gamma", "Δ": "delta", "Ε": "epsilon"}
NEGATIONS = ("but not", "rather than", "independent of", "independently of", "excluding", "without", "not")
NEGATION_WINDOW = 24
