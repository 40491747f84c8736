"""casebook.plans"""
