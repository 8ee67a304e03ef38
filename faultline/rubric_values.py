"""The grading rubrics, one row per criterion.

Criterion texts are matched verbatim by the criteria audit, so they are kept exactly as published.
"""

# The standard graded against for each asset class, and the bridge alternative.
STANDARD_OF_CLASS = {
    "bridge_element": "MBEI-CS",
    "steel_coating": "CorrosionCS",
    "pv_module": "IEC-62446-3-CoA",
    "building_disaster": "FEMA-PDA",
}
BRIDGE_ALTERNATIVE = "NBI-0-9"

# Native values allowed by each standard, in rubric order.
ALLOWED_VALUES = {
    "MBEI-CS": ["CS1", "CS2", "CS3", "CS4"],
    "NBI-0-9": ["9", "8", "7", "6", "5", "4", "3", "2", "1", "0"],
    "CorrosionCS": ["Good", "Fair", "Poor", "Severe"],
    "IEC-62446-3-CoA": ["CoA 1", "CoA 2", "CoA 3"],
    "FEMA-PDA": ["Undamaged", "Affected", "Minor", "Major", "Destroyed", "Inaccessible"],
}

# Fixed values: (standard, subject, value, criterion, level, action, flag).
RUBRIC_ROWS = [
    ("MBEI-CS", "cracking (reinforced concrete)", "CS1", "Width less than 0.012 in (insignificant cracks or moderate-width cracks that have been sealed).", "S0", "record", None),
    ("MBEI-CS", "cracking (reinforced concrete)", "CS2", "Unsealed moderate-width cracks 0.012 to 0.05 in wide, or unsealed moderate pattern (map) cracking.", "S1", "monitor", None),
    ("MBEI-CS", "cracking (reinforced concrete)", "CS3", "Wide cracks greater than 0.05 in or heavy pattern (map) cracking.", "S2", "schedule", None),
    ("MBEI-CS", "cracking (prestressed concrete)", "CS1", "Width less than 0.004 in.", "S0", "record", None),
    ("MBEI-CS", "cracking (prestressed concrete)", "CS2", "Width 0.004 to 0.009 in.", "S1", "monitor", None),
    ("MBEI-CS", "cracking (prestressed concrete)", "CS3", "Width greater than 0.009 in.", "S2", "schedule", None),
    ("MBEI-CS", "delamination / spall / patched area", "CS1", "None.", "S0", "record", None),
    ("MBEI-CS", "delamination / spall / patched area", "CS2", "Delaminated; spall 1 in or less deep or 6 in or less in diameter; patched area that is sound.", "S1", "monitor", None),
    ("MBEI-CS", "delamination / spall / patched area", "CS3", "Spall greater than 1 in deep or greater than 6 in in diameter; patched area that is unsound or showing distress.", "S2", "schedule", None),
    ("MBEI-CS", "exposed rebar", "CS2", "Present without measurable section loss.", "S2", "schedule", None),
    ("MBEI-CS", "exposed rebar", "CS3", "Present with measurable section loss but does not warrant structural review.", "S3", "prioritize", None),
    ("MBEI-CS", "efflorescence / rust staining", "CS2", "Surface white without build-up or leaching without rust staining.", "S1", "monitor", None),
    ("MBEI-CS", "efflorescence / rust staining", "CS3", "Heavy build-up with rust staining.", "S2", "schedule", None),
    ("MBEI-CS", "any defect", "CS4", "The condition warrants a structural review to determine the effect on strength or serviceability of the element or bridge, or a structural review has been completed and the defects impact strength or serviceability.", "S3", "prioritize", "load_posting_review"),
    ("NBI-0-9", None, "9", "Excellent condition; no deficiencies.", "S0", "record", None),
    ("NBI-0-9", None, "8", "Very good condition; no problems noted.", "S0", "record", None),
    ("NBI-0-9", None, "7", "Good condition; some minor problems.", "S1", "monitor", None),
    ("NBI-0-9", None, "6", "Satisfactory condition; structural elements show some minor deterioration.", "S1", "monitor", None),
    ("NBI-0-9", None, "5", "Fair condition; all primary structural elements are sound but may have minor section loss, cracking, spalling or scour.", "S2", "schedule", None),
    ("NBI-0-9", None, "4", "Poor condition; advanced section loss, deterioration, spalling or scour.", "S3", "prioritize", None),
    ("NBI-0-9", None, "3", "Serious condition; loss of section, deterioration, spalling or scour have seriously affected primary structural components; local failures are possible.", "S3", "prioritize", "load_posting_review"),
    ("NBI-0-9", None, "2", "Critical condition; advanced deterioration of primary structural elements; unless closely monitored it may be necessary to close the bridge until corrective action is taken.", "S4", "escalate", None),
    ("NBI-0-9", None, "1", "Imminent failure condition; major deterioration or section loss present in critical structural components; bridge is closed to traffic but corrective action may put it back in light service.", "S4", "escalate", None),
    ("NBI-0-9", None, "0", "Failed condition; out of service, beyond corrective action.", "S4", "escalate", None),
    ("CorrosionCS", None, "Good", "'Good' Rating: No visible corrosion / Minimal corrosion. All defect types with a condition better than 'Fair' condition state 2 (CS2) are considered 'Good' condition state 1 (CS1). Peeling paint is not annotated as corrosion.", "S0", "record", None),
    ("CorrosionCS", None, "Fair", "Surface Corrosion: Corroded portions of steel that do not appear to be disintegrating are annotated as '2 - Fair'. Exposed Steel: Peeled paint that exposes and corrodes underlying steel is considered '2 - Fair'. Freckled Rust/Sporadic Corrosion: Corrosion that is clustered or scattered in a general region is annotated as a single mass of corrosion (typically '2 - Fair'). Streaked Corrosion: Corrosion that appears to be streaked or to discolor steel is annotated as 2 - Fair.", "S1", "monitor", None),
    ("CorrosionCS", None, "Poor", "'Poor' Rating: Corrosion that appears as deeper-than-surface corrosion or beginning to disintegrate portions of steel is considered '3 - Poor' (includes Pack Rust).", "S2", "schedule", "section_loss"),
    ("CorrosionCS", None, "Severe", "'Severe' Rating: Corrosion that seems to have disintegrated portions of steel and/or corrosion that seems to affect structural integrity of the bridge component is annotated as '4 - Severe'. Section Loss: Steel with complete section loss (holes or cavities) should be annotated as severe with surrounding areas annotated appropriately.", "S3", "prioritize", "load_posting_review"),
    ("IEC-62446-3-CoA", "no thermal abnormality", "CoA 1", "No abnormality; module uniform in temperature relative to neighbours.", "S0", "record", None),
    ("IEC-62446-3-CoA", "single hot cell", "CoA 2", "Single cell warmer than the module by 10 to 40 K.", "S3", "prioritize", None),
    ("IEC-62446-3-CoA", "single hot cell", "CoA 3", "Single cell warmer than the module by more than 40 K.", "S4", "escalate", None),
    ("IEC-62446-3-CoA", "module or substring open circuit", "CoA 2", "Whole module or a substring (one bypass-diode section) warmer by 2 to 7 K in a uniform pattern.", "S2", "schedule", None),
    ("IEC-62446-3-CoA", "broken front glass", "CoA 3", "Broken front glass with irregular thermal pattern, delta-T 0 to 7 K; safety relevant regardless of temperature.", "S4", "escalate", "fire_shock_pathway"),
    ("IEC-62446-3-CoA", "hot spot with burn marks or exposed conductors", "CoA 3", "Localised hot spot with visible burn marks, melted encapsulant or exposed conductor; safety relevant.", "S4", "escalate", "fire_shock_pathway"),
    ("IEC-62446-3-CoA", "shading, soiling or vegetation", "CoA 1", "Temperature pattern explained by external shading, soiling or vegetation rather than a module defect; note as maintenance item.", "S1", "monitor", None),
    ("IEC-62446-3-CoA", "string, combiner or inverter outage", "CoA 2", "A whole string or group of modules uniformly warmer than neighbours consistent with an open circuit upstream.", "S3", "prioritize", None),
    ("FEMA-PDA", None, "Undamaged", "No visible damage to roof, walls or surroundings.", "S0", "record", None),
    ("FEMA-PDA", None, "Affected", "Cosmetic damage only: some shingles or siding missing, debris on the property, building habitable; roughly 1 to 9 percent of the structure affected.", "S1", "monitor", None),
    ("FEMA-PDA", None, "Minor", "Nonstructural damage such as partial roof covering loss, broken windows or doors, minor water intrusion; repairable and habitable after repair; roughly 10 to 25 percent.", "S2", "schedule", None),
    ("FEMA-PDA", None, "Major", "Structural damage: roof decking or wall sections gone, partial collapse, building not safe to occupy until repaired; roughly 26 to 50 percent.", "S3", "prioritize", None),
    ("FEMA-PDA", None, "Destroyed", "Total loss or damage so extensive that repair is not feasible: collapse, only foundation or debris field remaining; more than 50 percent.", "S4", "escalate", None),
    ("FEMA-PDA", None, "Inaccessible", "Structure cannot be assessed from the image (obscured by water, smoke, trees, cloud or outside the frame).", "U", "monitor", None),
]

# Thresholds for measured values, lowest first: (standard, subject, measure, threshold, strict, value).
# A value applies once the measure reaches the threshold (exceeds it, when strict) and no later one does.
MEASURED_THRESHOLDS = [
    ("MBEI-CS", "cracking (reinforced concrete)", "crack_width_in", 0.0, False, "CS1"),
    ("MBEI-CS", "cracking (reinforced concrete)", "crack_width_in", 0.012, False, "CS2"),
    ("MBEI-CS", "cracking (reinforced concrete)", "crack_width_in", 0.05, True, "CS3"),
    ("MBEI-CS", "cracking (prestressed concrete)", "crack_width_in", 0.0, False, "CS1"),
    ("MBEI-CS", "cracking (prestressed concrete)", "crack_width_in", 0.004, False, "CS2"),
    ("MBEI-CS", "cracking (prestressed concrete)", "crack_width_in", 0.009, True, "CS3"),
    ("IEC-62446-3-CoA", "single hot cell", "delta_t_k", 10.0, False, "CoA 2"),
    ("IEC-62446-3-CoA", "single hot cell", "delta_t_k", 40.0, True, "CoA 3"),
    ("FEMA-PDA", "building", "percent_damage", 0.0, False, "Undamaged"),
    ("FEMA-PDA", "building", "percent_damage", 1.0, False, "Affected"),
    ("FEMA-PDA", "building", "percent_damage", 10.0, False, "Minor"),
    ("FEMA-PDA", "building", "percent_damage", 26.0, False, "Major"),
    ("FEMA-PDA", "building", "percent_damage", 50.0, True, "Destroyed"),
]
MIN_IRRADIANCE_WM2 = 600.0
MM_PER_INCH = 25.4
