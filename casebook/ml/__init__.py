"""casebook.ml"""
