"""Schemas of the tables that pass between steps."""

MESSAGES = "array<struct<role:string,content:string>>"
SAMPLE = f"id string, lang string, corpus string, split string, ref string, messages {MESSAGES}, prompt string, source string, target string"
PREDICTION = "id string, lang string, source string, prediction string"
REFERENCE = "id string, target string, source string, lang string"

# Language codes the instruction names in full.
LANGUAGES = {
    "cs": "Czech", "en": "English", "et": "Estonian", "de": "German", "el": "Greek", "is": "Icelandic",
    "it": "Italian", "lv": "Latvian", "ru": "Russian", "sl": "Slovene", "sv": "Swedish", "uk": "Ukrainian",
}
SPLITS = ("train", "dev", "test")
