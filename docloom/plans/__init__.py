"""Plans of questions: intermediate form, validation, lowering, execution."""
