"""Enumerations, weights, scales and crosswalks that results must agree on.

Everything in this module is a lookup table or a constant. No logic lives here.
"""

# Enumerations of the finding contract.
ASSET_CLASSES = ["bridge_element", "steel_coating", "pv_module", "building_disaster"]
LEVELS = ["S0", "S1", "S2", "S3", "S4", "U"]
STANDARDS = ["NBI-0-9", "MBEI-CS", "ISO-4628-3", "IEC-62446-3-CoA", "FEMA-PDA", "CorrosionCS"]
ACTION_CODES = ["record", "monitor", "schedule", "prioritize", "escalate"]
FLAGS = ["fire_shock_pathway", "load_posting_review", "section_loss", "not_measurable"]
REVIEW_ACTIONS = ["accepted", "overridden", "marked_u"]

# Order and severity weight of the assessable levels.
LEVEL_ORDINAL = {"S0": 0, "S1": 1, "S2": 2, "S3": 3, "S4": 4}
SEVERITY_WEIGHT = {"S0": 0.0, "S1": 1.0, "S2": 3.0, "S3": 9.0, "S4": 27.0}

# Routing threshold, forced classes, tile geometry, model input sizes.
MIN_CLEAN_CONFIDENCE = 0.7
FORCED_CLASSES = ["pv_module"]
TILE_SIDE = 1568
TILE_OVERLAP = 0.15
MIN_MODEL_SIDE = 224
TOKEN_PATCH_SIDE = 28

# Grade scales, lowest grade first.
STEEL_GRADES = ["Good", "Fair", "Poor", "Severe"]
PV_GRADES = ["CoA 1", "CoA 2", "CoA 3"]
SCENE_GRADES = ["Intact", "Damaged", "Collapsed"]
BRIDGE_GRADES = ["CS1", "CS2", "CS3", "CS4"]
GRADE_LABELS = {
    "bridge_element": BRIDGE_GRADES,
    "steel_coating": STEEL_GRADES,
    "pv_module": PV_GRADES,
    "building_disaster": SCENE_GRADES,
}

# Post-disaster damage classes and the scene grade each one counts as.
DISASTER_CLASSES = ["Undamaged", "Affected", "Minor", "Major", "Destroyed", "Inaccessible"]
DISASTER_TO_SCENE = {
    "Undamaged": "Intact",
    "Affected": "Intact",
    "Minor": "Damaged",
    "Major": "Damaged",
    "Destroyed": "Collapsed",
}
SCENE_TO_LEVEL = {"Intact": "S0", "Damaged": "S2", "Collapsed": "S4"}
SCENE_TO_DISASTER = {
    "Intact": ["Undamaged", "Affected"],
    "Damaged": ["Minor", "Major"],
    "Collapsed": ["Destroyed"],
}

# Thermal dataset classes in dataset index order, with their grade and level.
THERMAL_CLASSES = [
    "Cell",
    "Cell-Multi",
    "Cracking",
    "Diode",
    "Diode-Multi",
    "Hot-Spot",
    "Hot-Spot-Multi",
    "No-Anomaly",
    "Offline-Module",
    "Shadowing",
    "Soiling",
    "Vegetation",
]

# Grade and level of each thermal class, as published.
THERMAL_CROSSWALK = [
    ("No-Anomaly", "CoA 1", "S0"),
    ("Shadowing", "CoA 1", "S1"),
    ("Soiling", "CoA 1", "S1"),
    ("Vegetation", "CoA 1", "S1"),
    ("Diode", "CoA 2", "S2"),
    ("Diode-Multi", "CoA 2", "S2"),
    ("Offline-Module", "CoA 2", "S2"),
    ("Cell", "CoA 2", "S3"),
    ("Cell-Multi", "CoA 2", "S3"),
    ("Hot-Spot", "CoA 2", "S3"),
    ("Hot-Spot-Multi", "CoA 2", "S3"),
    ("Cracking", "CoA 3", "S4"),
]
THERMAL_TO_GRADE = {name: grade for name, grade, _ in THERMAL_CROSSWALK}
THERMAL_TO_LEVEL = {name: level for name, _, level in THERMAL_CROSSWALK}

# Concrete defect classes that count as damage, and the six sampled by quota.
CONCRETE_DAMAGE_CLASSES = [
    "Crack",
    "ACrack",
    "Spalling",
    "Rust",
    "ExposedRebars",
    "Efflorescence",
    "Cavity",
    "Hollowareas",
    "Rockpocket",
    "Wetspot",
    "WConccor",
    "Weathering",
]
CONCRETE_QUOTAS = [
    ("Crack", 10),
    ("ACrack", 5),
    ("Spalling", 10),
    ("Rust", 10),
    ("ExposedRebars", 10),
    ("Efflorescence", 10),
]

# Sampled slices of each dataset, class -> [(split, from, to)] in shuffle order, and the seed.
SAMPLING_SEED = 20260925
STEEL_SLICES = {"Fair": [("dev", 0, 5)], "Poor": [("dev", 0, 5)], "Severe": [("dev", 0, 5)]}
SCENE_SLICES = {
    "Intact": [("eval_v1", 0, 13), ("dev", 13, 16)],
    "Damaged": [("eval_v1", 0, 14), ("dev", 14, 17)],
    "Collapsed": [("eval_v1", 0, 13), ("dev", 13, 15)],
}
THERMAL_SLICES = {
    "Cell": [("eval_v1", 0, 3), ("dev", 3, 4)],
    "Cell-Multi": [("eval_v1", 0, 2), ("dev", 3, 4)],
    "Cracking": [("eval_v1", 0, 2), ("dev", 3, 4)],
    "Diode": [("eval_v1", 0, 3), ("dev", 3, 4)],
    "Diode-Multi": [("eval_v1", 0, 2), ("dev", 3, 4)],
    "Hot-Spot": [("eval_v1", 0, 3), ("dev", 3, 4)],
    "Hot-Spot-Multi": [("eval_v1", 0, 2), ("dev", 3, 4)],
    "No-Anomaly": [("eval_v1", 0, 15), ("dev", 15, 19)],
    "Offline-Module": [("eval_v1", 0, 2), ("dev", 3, 4)],
    "Shadowing": [("eval_v1", 0, 2)],
    "Soiling": [("eval_v1", 0, 2)],
    "Vegetation": [("eval_v1", 0, 2)],
}
