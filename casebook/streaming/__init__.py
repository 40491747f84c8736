"""casebook.streaming"""
