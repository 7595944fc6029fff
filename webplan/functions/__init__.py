"""webplan.functions"""
