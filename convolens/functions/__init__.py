"""Column functions: text, numbers, arrays, fuzzy matching, JSON. All but the JSON scan are JVM expressions."""
