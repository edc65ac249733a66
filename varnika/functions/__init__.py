from varnika.functions.text import BLANK, clean_transcript, devanagari_words, display_name, final_answer, first_line, is_blank, last_tag, nfc, pair_class, phonetic_form, plain, py_nfc, py_words, routing_form, script_class, squeeze, strip, tokens, whole_sentences

__all__ = ["BLANK", "clean_transcript", "devanagari_words", "display_name", "final_answer", "first_line", "is_blank", "last_tag", "nfc", "pair_class", "phonetic_form", "plain", "py_nfc", "py_words", "routing_form", "script_class", "squeeze", "strip", "tokens", "whole_sentences"]
