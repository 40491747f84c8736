"""casebook.functions"""
