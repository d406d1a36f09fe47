"""Dictionaries, word lists and the spatial atlas.

Every list is ordered; the first entry that matches wins.  All of them are
defaults of keyword parameters, so a caller can pass other vocabularies.
"""

# Organ keyword -> canonical organ name.
ANATOMY_KEYWORDS = [
    ("liver", "liver"), ("hepatic", "liver"),
    ("kidney", "kidney"), ("renal", "kidney"),
    ("lung", "lung"), ("pulmonary", "lung"), ("lobe", "lung"),
    ("spleen", "spleen"), ("splenic", "spleen"),
    ("heart", "heart"), ("cardiac", "heart"), ("coronary", "heart"),
    ("aorta", "aorta"), ("aortic", "aorta"),
    ("pancrea", "pancreas"),
    ("gallbladder", "gallbladder"),
    ("bladder", "bladder"),
    ("thyroid", "thyroid"),
    ("stomach", "stomach"), ("gastric", "stomach"),
    ("esophag", "esophagus"),
    ("colon", "colon"), ("intestin", "intestine"), ("bowel", "intestine"),
    ("pelvi", "pelvis"), ("inguinal", "pelvis"),
    ("pleura", "pleura"), ("pleural", "pleura"),
    ("mediastin", "mediastinum"),
    ("peritoneum", "peritoneum"), ("mesentery", "peritoneum"),
    ("prostate", "prostate"),
    ("uterus", "uterus"), ("uterine", "uterus"),
    ("brain", "brain"), ("cerebr", "brain"),
    ("orbit", "orbit"),
    ("vertebr", "spine"), ("cervical", "spine"), ("lumbar", "spine"),
    ("thoracic", "spine"), ("spinal", "spine"), ("spine", "spine"),
    ("spondyl", "spine"), ("disc", "spine"), ("intervertebral", "spine"),
    ("vocal", "larynx"), ("piriform", "larynx"), ("laryn", "larynx"),
    ("lymph", "lymph_node"),
    ("bone", "bone"), ("osteophyte", "bone"), ("fracture", "bone"),
]

# Finding keyword -> canonical finding.
FINDING_KEYWORDS = [
    ("mass", "mass"), ("tumor", "mass"),
    ("nodule", "nodule"), ("nodular", "nodule"),
    ("cyst", "cyst"), ("cystic", "cyst"),
    ("calcif", "calcification"),
    ("effusion", "effusion"),
    ("emphysema", "emphysema"),
    ("atelectasis", "atelectasis"),
    ("pneumonia", "pneumonia"),
    ("fracture", "fracture"),
    ("hernia", "hernia"),
    ("stenosis", "stenosis"),
    ("thicken", "thickening"),
    ("enlarg", "enlargement"), ("splenomegaly", "enlargement"),
    ("dilat", "dilation"),
    ("osteophyte", "osteophyte"),
    ("spondyl", "spondylosis"),
    ("dissection", "dissection"),
    ("hemorrhage", "hemorrhage"),
    ("edema", "edema"),
    ("cirrhosis", "cirrhosis"),
    ("ascites", "ascites"),
]

# Vertebral levels C1-C7, T1-T12, L1-L5, S1, in that order.
SPINE_LEVELS = [
    f"{region}{i}"
    for region, last in (("C", 7), ("T", 12), ("L", 5), ("S", 1))
    for i in range(1, last + 1)
]

# Words that decide focality, spread and laterality.
MULTIPLE_WORDS = ["multiple", "several", "numerous"]
BILATERAL_WORDS = ["bilateral", "both"]
DIFFUSE_WORDS = ["diffuse", "scattered"]

# Finding terms of the whole-word extractor and their singulars.
FINDING_TERMS = [
    "lymph nodes", "lymph node", "cysts", "cyst", "masses", "mass",
    "tumors", "tumours", "tumor", "tumour", "nodules", "nodule",
    "calcifications", "calcification", "stones", "calculi", "calculus",
    "fluid collection", "effusion", "hematoma", "hemorrhage", "bleeding",
    "abscess", "opacities", "opacity", "infiltrate", "emphysema",
    "atelectasis", "fracture", "aneurysm", "thickening", "lesions", "lesion",
]
FINDING_SINGULAR = {
    "lymph nodes": "lymph node", "cysts": "cyst", "masses": "mass",
    "tumors": "tumor", "tumours": "tumor", "tumour": "tumor",
    "nodules": "nodule", "calcifications": "calcification",
    "stones": "stone", "calculi": "calculus", "opacities": "opacity",
    "lesions": "lesion",
}

# Two short keyword lists for compact prompts (orders differ).
SHORT_KEYWORDS = ["lymph node", "mass", "nodule", "cyst", "tumor", "lesion"]
SHORT_KEYWORDS_VARIANT = ["mass", "lymph node", "nodule", "cyst", "tumor", "lesion"]

# Phrases deleted, in this order and case, when shortening a text.
FILLER_PHRASES = [
    "is seen", "are seen", "is observed", "are observed", "is noted",
    "are noted", "is considered", "considering", "It is", "which is",
    "suggesting", "indicative of", "with a tendency towards", "possibly",
    "probably",
]

# Anatomical terms of the longest-match keyword.
ANATOMY_TERMS = [
    "liver", "kidney", "spleen", "lung", "heart", "aorta", "vertebra",
    "spine", "cervical", "thoracic", "lumbar", "lymph node", "gallbladder",
    "pancreas", "stomach", "pelvis", "inguinal", "ureter", "bladder",
    "thyroid", "esophagus", "trachea", "bronch", "rib", "sternum", "colon",
    "rectum", "adrenal", "prostate", "uterus", "ovary", "femur", "sacrum",
    "coccyx", "iliac", "vocal cord", "cartilage", "nodule", "mass", "lesion",
    "cyst", "tumor", "calcification", "effusion", "ascites",
]

# Organ -> (z from, z to, y from, x from, y to, x to), fractions.
ATLAS = {
    "brain": (0.0, 0.3, 0.1, 0.1, 0.9, 0.9),
    "orbit": (0.0, 0.2, 0.2, 0.1, 0.6, 0.9),
    "thyroid": (0.1, 0.4, 0.3, 0.2, 0.7, 0.8),
    "larynx": (0.1, 0.4, 0.3, 0.2, 0.7, 0.8),
    "lung": (0.1, 0.8, 0.05, 0.05, 0.95, 0.95),
    "heart": (0.3, 0.7, 0.2, 0.2, 0.8, 0.8),
    "aorta": (0.1, 0.9, 0.2, 0.3, 0.8, 0.7),
    "mediastinum": (0.2, 0.7, 0.2, 0.2, 0.8, 0.8),
    "esophagus": (0.2, 0.8, 0.3, 0.3, 0.7, 0.7),
    "pleura": (0.1, 0.9, 0.05, 0.05, 0.95, 0.95),
    "liver": (0.2, 0.7, 0.1, 0.05, 0.7, 0.6),
    "gallbladder": (0.3, 0.6, 0.3, 0.2, 0.6, 0.5),
    "spleen": (0.2, 0.6, 0.1, 0.5, 0.6, 0.95),
    "pancreas": (0.3, 0.6, 0.2, 0.2, 0.6, 0.8),
    "kidney": (0.3, 0.7, 0.15, 0.1, 0.7, 0.9),
    "stomach": (0.2, 0.6, 0.2, 0.3, 0.7, 0.8),
    "intestine": (0.3, 0.9, 0.1, 0.1, 0.9, 0.9),
    "peritoneum": (0.2, 0.9, 0.1, 0.1, 0.9, 0.9),
    "pelvis": (0.6, 1.0, 0.1, 0.1, 0.9, 0.9),
    "bladder": (0.6, 0.9, 0.2, 0.2, 0.8, 0.8),
    "prostate": (0.7, 0.95, 0.3, 0.3, 0.7, 0.7),
    "uterus": (0.6, 0.9, 0.2, 0.2, 0.8, 0.8),
    "spine": (0.0, 1.0, 0.3, 0.2, 0.9, 0.8),
    "bone": (0.0, 1.0, 0.1, 0.1, 0.9, 0.9),
    "lymph_node": (0.1, 0.9, 0.1, 0.1, 0.9, 0.9),
    "unknown": (0.0, 1.0, 0.0, 0.0, 1.0, 1.0),
}

# Horizontal range of a body side, and organs it does not narrow.
SIDE_X_RANGE = {"left": (0.5, 1.0), "right": (0.0, 0.5)}
SIDE_EXEMPT_ANATOMY = ["spine", "bone", "aorta"]
